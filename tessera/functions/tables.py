"""Table functions for SQL. They see a table a partition at a time and add columns to those that came in."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


class FindLines:
    """find_lines(TABLE(t) PARTITION BY ..., text => 'column', pattern => '...'): a row for each line in which the pattern is found, with the
    other columns of t as they are, the line's number, what was found first in it, and the number of the hit within its
    partition. The output's columns follow from the input's. A null text has no line. Extra columns that are called like
    the function's own are left out."""

    OWN = ("line_no", "found", "hit")

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(text.value, str) or text.value not in rows.dataType.fieldNames():
            raise ValueError("find_lines takes a table, the name of a column of it, and a pattern")
        re.compile(pattern.value)
        kept = [f for f in rows.dataType.fields if f.name != text.value and f.name not in FindLines.OWN]
        return AnalyzeResult(StructType([*kept, StructField("line_no", IntegerType()), StructField("found", StringType()), StructField("hit", LongType())]))

    def __init__(self) -> None:
        self.hit, self.pattern, self.kept = 0, None, None

    def eval(self, rows: Row, text: str, pattern: str) -> Iterator[tuple]:
        if self.pattern is None:
            self.pattern = re.compile(pattern)
            self.kept = [f for f in rows.__fields__ if f != text and f not in self.OWN]
        for n, line in enumerate((rows[text] or "").split("\n"), 1):
            found = self.pattern.search(line)
            if found:
                self.hit += 1
                yield (*[rows[f] for f in self.kept], n, found[0], self.hit)


def register(spark: SparkSession) -> None:
    spark.udtf.register("find_lines", udtf(FindLines))

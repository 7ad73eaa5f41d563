"""Quality rules as a short-circuit cascade.

Each rule reads a few figures of a text, and a figure is computed when a rule first reads it. On a sample of texts, the
first by hash over the whole table, the executors measure each rule's cost (seconds a text) and selectivity (share of
texts that it rejects); the cascade then runs them by rejection per cost, and a text that one rule rejects is not shown to
the later ones, so their figures are never computed. The order changes the cost only: the verdict is the conjunction of
all rules.

Nulls and empty texts have no words, so they fail the base rule and are not kept. A null doc_id is carried through.
Repeated rows each get their own row; rules of equal score keep the given order. Very long texts are read whole, one at a
time, in the sample too. An empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Writer, only, rows, table

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\r\x0b\x0c"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search


class Figures:
    """The figures of one text, each computed when it is first read."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.cache: dict[str, int] = {}

    def __getattr__(self, name: str) -> int:
        if name not in FIGURES:
            raise AttributeError(name)
        if name not in self.cache:
            self.cache[name] = FIGURES[name](self)
        return self.cache[name]

    @property
    def words(self) -> list[bytes]:
        if "words" not in self.__dict__:
            self.__dict__["words"] = self.text.encode("utf-8", "surrogatepass").split()
        return self.__dict__["words"]

    @property
    def lines(self) -> list[str]:
        """Lines with a word."""
        if "lines" not in self.__dict__:
            self.__dict__["lines"] = [x for x in self.text.split("\n") if x.strip(BLANK)]
        return self.__dict__["lines"]


def n_words(f: Figures) -> int:
    return len(f.words)


def word_chars(f: Figures) -> int:
    return len(f.text) - sum(map(f.text.count, " \t\n\r\x0b\x0c"))


def n_symbols(f: Figures) -> int:
    return sum(map(f.text.count, SYMBOLS))


def n_dup_lines(f: Figures) -> int:
    return len(f.lines) - len(set(f.lines))


def n_repeat_words(f: Figures) -> int:
    """Words within five-word windows that occur twice or more, first occurrences included."""
    w = f.words
    if len(w) < 6:
        return 0
    grams = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    covered, until = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + 5 - max(i, until)
            until = i + 5
    return covered


def n_letter_words(f: Figures) -> int:
    """Words with a letter of ASCII or any character beyond it."""
    return sum(map(bool, map(LETTER, f.words)))


def n_bullet_lines(f: Figures) -> int:
    return sum(x.lstrip(BLANK).startswith(("-", "*", "\u2022")) for x in f.lines)


def n_ellipsis_lines(f: Figures) -> int:
    return sum(x.rstrip(BLANK).endswith(("...", "\u2026")) for x in f.lines)


#: The figures that the query returns; the others serve their rules alone.
TOLD = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
FIGURES: dict[str, Callable[[Figures], int]] = {f.__name__: f for f in (*TOLD, n_letter_words, n_bullet_lines, n_ellipsis_lines)}


@dataclass(frozen=True)
class Rule:
    """rejects tells whether a text with these figures goes; sql is the same for an engine that has the figures as columns."""

    name: str
    rejects: Callable[[Figures], bool]
    sql: str


BASE = Rule("base", lambda f: f.n_words < 10 or 100 * f.n_repeat_words > 20 * f.n_words, "n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
#: Loose bounds: ordinary prose of any of the languages stays far within them.
RULES = (
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words, "100 * n_symbols > 10 * n_words"),
    Rule("word_length", lambda f: word_length_off(f.n_words, f.word_chars), "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("dup_lines", lambda f: 100 * f.n_dup_lines > 30 * (f.text.count("\n") + 1), "100 * n_dup_lines > 30 * n_lines"),
    Rule("letters", lambda f: 100 * f.n_letter_words < 70 * f.n_words, "100 * n_letter_words < 70 * n_words"),
    Rule("bullets", lambda f: 100 * f.n_bullet_lines > 90 * len(f.lines), "100 * n_bullet_lines > 90 * n_filled"),
    Rule("ellipses", lambda f: 100 * f.n_ellipsis_lines > 30 * len(f.lines), "100 * n_ellipsis_lines > 30 * n_filled"),
)


def word_length_off(words: int, chars: int) -> bool:
    return chars < 2 * words or chars > 25 * words


@dataclass
class Measured:
    rule: Rule
    seconds: float
    rejected: float
    score: float = field(init=False)

    def __post_init__(self) -> None:
        self.score = self.rejected / max(self.seconds, 1e-9)


def measure(texts: Iterable[str | None], rules: tuple[Rule, ...]) -> list[tuple[float, int, int]]:
    """(seconds, rejected texts, texts) of each rule on its own."""
    seconds, hits, n = [0.0] * len(rules), [0] * len(rules), 0
    for t in texts:
        n += 1
        for i, rule in enumerate(rules):
            began = time.perf_counter()
            hits[i] += rule.rejects(Figures(t))
            seconds[i] += time.perf_counter() - began
    return [(s, h, n) for s, h in zip(seconds, hits, strict=True)]


def ordered(rules: tuple[Rule, ...], told: list[tuple[float, int, int]]) -> list[Measured]:
    """Best rejection per cost first; ties keep the given order."""
    return sorted((Measured(r, s / max(1, n), h / max(1, n)) for r, (s, h, n) in zip(rules, told, strict=True)), key=lambda m: -m.score)


class Cascade:
    """Rules in the order of rejection per cost."""

    def __init__(self, rules: tuple[Rule, ...] = (BASE, *RULES)) -> None:
        self.rules = rules

    def planned(self, docs: DataFrame, text_col: str = "text", sample_rows: int = 300) -> Cascade:
        """The same rules ordered by what sample_rows texts show, those of the smallest hashes in the table; the sample
        orders them and decides nothing else. Only sums reach the driver."""
        rules, hashed = self.rules, only(docs, text=text_col).withColumn("h", F.xxhash64("text"))
        last = hashed.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
        schema = pa.schema([("rule", pa.int32()), ("seconds", pa.float64()), ("hits", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = measure((t for (t,) in rows(batches, "text")), rules)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(i, *x) for i, x in enumerate(told)], strict=True), schema, strict=True)], schema=schema)

        sample = hashed.where(F.col("h") <= F.lit(0 if last is None else last)).limit(sample_rows).select("text")
        sums = {r.rule: (r.s, r.h, r.k) for r in sample.mapInArrow(run, "rule int, seconds double, hits bigint, n bigint").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("hits").alias("h"), F.sum("n").alias("k")).collect()}
        return Cascade(tuple(m.rule for m in ordered(rules, [sums.get(i, (0.0, 0, 0)) for i in range(len(rules))])))

    def first_rejection(self, f: Figures) -> str | None:
        for rule in self.rules:
            if rule.rejects(f):
                return rule.name
        return None

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", figures: bool = False) -> DataFrame:
        """One row per document: doc_id, kept, rejected_by (the first rule that rejects it) and, on request, the figures of TOLD."""
        rules, names = self.rules, [f.__name__ for f in TOLD] if figures else []
        schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.bool_()), ("rejected_by", pa.string()), *[(n, pa.int64()) for n in names]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(schema)
            for doc_id, text in rows(batches, "doc_id", "text"):
                f = Figures(text)
                by = Cascade(rules).first_rejection(f)
                if out.add(doc_id, by is None, by, *[getattr(f, n) for n in names]):
                    yield out.take()
            yield out.take()

        spark_schema = "doc_id bigint, kept boolean, rejected_by string" + "".join(f", {n} bigint" for n in names)
        return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, spark_schema)

    def filter(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The documents that no rule rejects, all their columns, in one pass without a join."""
        rules = self.rules

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([Cascade(rules).first_rejection(Figures(t)) is None for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = Cascade().planned(docs).apply(docs, figures=True)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, text, w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         len(string_split(text, chr(10))) AS n_lines FROM t
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n FROM starts
), hits AS (
  SELECT DISTINCT doc_id, i + j AS at FROM grams, range(0, 5) AS r(j) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id
), f AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(len(text) - len(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, n_lines, len(l) AS n_filled,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM lines l LEFT JOIN repeats r ON l.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * n_letter_words < 70 * n_words OR 100 * n_bullet_lines > 90 * n_filled OR 100 * n_ellipsis_lines > 30 * n_filled) AS kept
FROM f
"""

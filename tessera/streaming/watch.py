"""Change-triggered runs: new files reach the gate once, and every cycle leaves an event and, if need be, an alert.

A file source with a checkpoint hands on only what it has not seen, so an unchanged folder causes no cycle.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import extension
from tessera.operators import gate
from tessera.operators.scan import line_findings
from tessera.plans.rules import Rule
from tessera.sources.files import excluded, lines


def fingerprint(files: DataFrame) -> DataFrame:
    """One number for a set of (path, stamp), whatever their order: hashes added up, wrapping."""
    total = F.sum(F.xxhash64("path", "stamp").cast("decimal(38,0)"))
    return files.agg(F.pmod(total, F.expr("CAST('9223372036854775808' AS DECIMAL(38,0))")).alias("fingerprint"), F.count("*").alias("n"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: list[Rule], once: bool = True, seconds: int = 5, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts the watch; `once` works off what is there and ends."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    files = stream.where(excluded(F.col("path")).isNull()).select("path", extension(F.col("path")).alias("ext"), "content")
    order = {c: i for i, c in enumerate(dict.fromkeys(r.cap for r in rules))}

    def cycle(batch: DataFrame, number: int) -> None:
        found = line_findings(lines(batch), [r for r in rules if r.kind == "line"], order).withColumn("verified", F.lit(True)).persist()
        try:
            verdict = gate.verdict(gate.bucketed(gate.keep_first(found)))
            verdict.withColumn("cycle", F.lit(number)).write.mode("append").json(os.path.join(out, "events"))
            found.withColumn("cycle", F.lit(number)).write.mode("append").parquet(os.path.join(out, "findings"))
            flag(verdict, os.path.join(out, "alert"))
            if after:
                after(verdict, number)
        finally:
            found.unpersist()

    writer = files.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def flag(verdict: DataFrame, path: str) -> None:
    """A verdict that blocks leaves an alert at path; one that does not takes it away."""
    spark = verdict.sparkSession
    if verdict.where("blocking > 0").isEmpty():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    else:
        verdict.write.mode("overwrite").json(path)


def until_stopped(query: StreamingQuery, folder: str, name: str = "STOP", seconds: float = 1.0) -> None:
    """Waits for a query until it ends or a file of that name stands in the folder, and then stops it."""
    spark = SparkSession.active()
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    files = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while not query.awaitTermination(max(1, int(seconds))):
        if files.exists(mark):
            query.stop()
            return


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by user and session of a stream or table of events (ts, user_id); a session ends with a gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and type of a stream or table of events (ts, event_type)."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")

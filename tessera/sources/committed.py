"""Sinks that show all of a write or nothing: one document from many tasks, and records with ids that have no gaps or doubles.

Both are Spark data sources with a commit in two phases. A task writes a file of its own attempt and tells the driver its name
and size; nothing refers to it yet. The commit makes what all tasks told visible in one step that can't be half done: a
file that is linked to its final name only if nothing has that name yet, or that replaces it if overwriting was asked
for. A task that fails takes its file away; an abort, or a commit that fails, takes all of them away.

The folder must be one that the driver and all executors have mounted; other paths are an error. Lines of a document pass
the driver as bytes, a buffer at a time, never whole.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.reports import sarif_lines

BUFFER = 1 << 20


def mounted(path: str) -> str:
    """The plain path of a folder or file on a mounted file system."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"{path}: not on a file system that is mounted on the driver and all executors")
    return path


def put_if_absent(body: Iterator[bytes], path: str, replace: bool = False) -> None:
    """Writes a file that appears with its whole content or not at all. FileExistsError if there is one of that name."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    made = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    try:
        with open(made, "xb") as f:
            for piece in body:
                f.write(piece)
            f.flush()
            os.fsync(f.fileno())
        if replace:
            os.replace(made, path)
        else:
            os.link(made, path)
    finally:
        if os.path.exists(made):
            os.unlink(made)


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    rows: int


class Staged(DataSourceWriter):
    """Tasks write lines into files of their own under a folder of this write."""

    def __init__(self, folder: str) -> None:
        self.staged = f"{folder}/{uuid.uuid4().hex}"

    def line(self, row: Row, i: int) -> str:
        return row[0]

    def write(self, iterator: Iterator[Row]) -> Part:
        context = TaskContext.get()
        os.makedirs(self.staged, exist_ok=True)
        number, rows = context.partitionId(), 0
        file = f"{self.staged}/part-{number:06d}-{context.taskAttemptId()}"
        try:
            with open(file, "x", encoding="utf-8", newline="") as f:
                for row in iterator:
                    f.write(self.line(row, rows))
                    f.write("\n")
                    rows += 1
        except BaseException:
            if os.path.exists(file):
                os.unlink(file)
            raise
        return Part(number, file, rows)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class DocumentWriter(Staged):
    """The lines of all tasks, in the order of partitions, between a head and a foot, with a comma after each but the last."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = mounted(options["path"]), overwrite
        self.head, self.foot = options.get("head", "[\n"), options.get("foot", "]\n")
        super().__init__(f"{os.path.dirname(self.path)}/.staged")

    def body(self, parts: list[Part]) -> Iterator[bytes]:
        yield self.head.encode()
        rest = sum(p.rows for p in parts)
        for part in sorted(parts, key=lambda p: p.number):
            with open(part.file, "rb", buffering=BUFFER) as f:
                for line in f:
                    rest -= 1
                    yield line if not rest else line[:-1] + b",\n"
        yield self.foot.encode()

    def commit(self, messages: list[Part | None]) -> None:
        try:
            put_if_absent(self.body([m for m in messages if m is not None and m.rows]), self.path, self.overwrite)
        finally:
            self.abort(messages)


class Document(DataSource):
    """One document from rows with one column, a line of text each; options path, head and foot."""

    @classmethod
    def name(cls) -> str:
        return "tessera_document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


class RecordWriter(Staged):
    """Records go into a log of commits. An entry names the parts and the first id of each; it is put under the next free number,
    so of two writers at a time one comes first and the other counts on from there."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = mounted(options["path"])
        super().__init__(f"{self.path}/data")

    def line(self, row: Row, i: int) -> str:
        return json.dumps({"i": i, "body": row[0]}, ensure_ascii=False)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda p: p.number)
        try:
            while parts:
                entry, first = last_entry(self.path)
                listed = []
                for p in parts:
                    listed.append({"file": os.path.relpath(p.file, self.path), "first": first, "rows": p.rows})
                    first += p.rows
                try:
                    put_if_absent(iter([json.dumps({"next": first, "parts": listed}).encode()]), f"{self.path}/_log/{entry + 1:020d}.json")
                    return
                except FileExistsError:  # another writer was first
                    time.sleep(0.01)
        except BaseException:
            self.abort(messages)
            raise


class Records(DataSource):
    """Appends rows with one column, the body of a record each; option path."""

    @classmethod
    def name(cls) -> str:
        return "tessera_records"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if overwrite:
            raise ValueError("records are only appended")
        return RecordWriter(dict(self.options))


def last_entry(folder: str) -> tuple[int, int]:
    """The number of the last commit, 0 if there is none, and the next free id."""
    log = f"{folder}/_log"
    names = [n for n in os.listdir(log) if n.endswith(".json") and not n.startswith(".")] if os.path.isdir(log) else []
    if not names:
        return 0, 0
    with open(f"{log}/{max(names)}", encoding="utf-8") as f:
        return int(max(names)[:20]), json.load(f)["next"]


REGISTERING = threading.Lock()


def register(spark: SparkSession) -> None:
    """Once a session; registering anew while another thread writes would take the source from it. A source is looked up in the
    session of the thread that writes, which a thread of one's own has none of before."""
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    with REGISTERING:
        if not getattr(spark, "_tessera_sources", False):
            spark.dataSource.register(Document)
            spark.dataSource.register(Records)
            spark._tessera_sources = True


def append_records(bodies: DataFrame, folder: str) -> None:
    """Appends a one-column table; ids count on from those that are there."""
    register(bodies.sparkSession)
    bodies.write.format("tessera_records").mode("append").option("path", folder).save()


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, body): the records of all commits. Files that no commit names are left out."""
    root = mounted(folder)
    log = spark.read.schema("parts array<struct<file:string,first:bigint,rows:bigint>>").json(f"{root}/_log")
    parts = log.select(F.explode("parts").alias("p")).select(F.element_at(F.split("p.file", "/"), -2).alias("write"), F.element_at(F.split("p.file", "/"), -1).alias("file"), "p.first")
    way = F.split(F.col("_metadata.file_path"), "/")
    rows = spark.read.schema("i bigint, body string").option("recursiveFileLookup", "true").json(f"{root}/data")
    rows = rows.select(F.element_at(way, -2).alias("write"), F.element_at(way, -1).alias("file"), "i", "body")
    return rows.join(parts, ["write", "file"]).select((F.col("first") + F.col("i")).alias("id"), "body")


def write_document(lines: DataFrame, path: str, head: str, foot: str, order: list[Column] | None = None, overwrite: bool = False) -> None:
    """One document from a one-column table of lines, in some order of its rows."""
    register(lines.sparkSession)
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    lines.select(lines.columns[0]).write.format("tessera_document").mode("overwrite" if overwrite else "append").options(path=path, head=head, foot=foot).save()


SARIF_HEAD = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "tessera"}}, "results": [\n'
SARIF_FOOT = "]}]}\n"


def write_sarif(findings: DataFrame, path: str, overwrite: bool = False) -> None:
    """One SARIF file: worst findings first, those of one severity by the order of analyses and rules, then by place."""
    place = ["path", "line_no", "rule"]
    lines = sarif_lines(findings, keep=["severity", *[c for c in ("cap_ord", "phase", "rule_ord") if c in findings.columns], *place])
    order = [F.desc("severity"), *[F.col(c) for c in lines.columns[2:]]]
    write_document(lines, path, SARIF_HEAD, SARIF_FOOT, order, overwrite)


SBOM_FOOT = "]}\n"


def write_sbom(components: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CycloneDX file from components (name, version, purl), by purl."""
    head = '{"bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "components": [\n'
    lines = components.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", "purl")).alias("value"), "purl")
    write_document(lines, path, head, SBOM_FOOT, [F.col("purl"), F.col("value")], overwrite)


def results_of(spark: SparkSession, path: str) -> DataFrame:
    """(rule, level, rank, path, line_no) of a SARIF file that write_sarif wrote: each result is a line, so files are read in splits."""
    kind = "ruleId string, level string, rank int, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
    lines = spark.read.text(path).where(F.col("value").startswith('{"ruleId"'))
    r = lines.select(F.from_json(F.regexp_replace("value", ",$", ""), kind).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return r.select(F.col("r.ruleId").alias("rule"), "r.level", "r.rank", place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line_no"))

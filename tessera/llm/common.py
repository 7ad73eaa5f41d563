"""What the operators of this subpackage share: the shared folder, partition counts, packed columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes that str.split() of an ASCII bytes object treats as white space: the complement of `[^\x20\x09-\x0D]`.
WORD_SPACE = b" \t\n\r\x0b\x0c"

SPACE = np.zeros(256, bool)
SPACE[list(WORD_SPACE)] = True


def word_bounds(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a UTF-8 buffer start and end."""
    inside = np.concatenate([[False], ~SPACE[body], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle: the cluster's own setting, which its owner sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A temporary one only where none is set and all runs on this
    machine, as in tests; on a cluster that is an error, as executors would not find it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        have = spark.sparkContext.getCheckpointDir()
        if not have:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            have = spark.sparkContext.getCheckpointDir()
        named = have
    return named.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, perhaps in folders by a column: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def dropped(table_: DataFrame, folder: str = "") -> None:
    """Deletes a written table, or a folder of it, that nothing will read again."""
    spark = table_.sparkSession
    files = table_.inputFiles()
    if files:
        root = re.sub(r"(/[^/]*-[0-9a-f]{32})/.*$", r"\1", files[0])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}".rstrip("/"))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operators' own names; extra columns, whatever they are called, stay out."""
    return df.select(*[df[f"`{source}`"].alias(own) for own, source in columns.items()])


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one zstandard frame: the dtypes and lengths, then the bytes."""
    head = ";".join(f"{a.dtype.str},{a.size}" for a in arrays).encode()
    body = b"".join([len(head).to_bytes(4, "little"), head, *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return zstandard.ZstdCompressor(level=level).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:4], "little")
    out, at = [], 4 + n
    for item in body[4 : 4 + n].decode().split(";"):
        kind, size = item.split(",")
        a = np.frombuffer(body, dtype=kind, count=int(size), offset=at)
        at += a.nbytes
        out.append(a)
    return out


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python tuples of the named columns, batch by batch."""
    for b in batches:
        yield from zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


class Writer:
    """Gathers output rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 2000, limit_bytes: int = 8 << 20) -> None:
        self.schema, self.limit, self.limit_bytes = schema, limit, limit_bytes
        self.cells: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, *cells, size: int = 0) -> bool:
        """Adds a row; True if the batch is full and should be taken."""
        for column, cell in zip(self.cells, cells, strict=True):
            column.append(cell)
        self.bytes += size
        return len(self.cells[0]) >= self.limit or self.bytes >= self.limit_bytes

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cells, self.schema, strict=True)], schema=self.schema)
        self.cells, self.bytes = [[] for _ in self.schema], 0
        return batch

"""Files as a relation: (path, ext, content); their lines as (path, ext, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import extension

#: Folders that hold no own source, the largest file that is read and how deep it may lie.
SERVICE_DIRS = ("target", "node_modules", "vendor", "dist", "build", "__pycache__")
MAX_BYTES, MAX_DEPTH = 1_000_000, 64
#: Language of an extension.
LANGUAGES = {
    "rs": "rust", "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "scala": "scala", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "dart": "dart",
}


def excluded(path: Column) -> Column:
    """Why a path is out of scope, or null: 'service' or 'hidden'. `.well-known` is in scope."""
    service = path.rlike(r"(^|/)(" + "|".join(SERVICE_DIRS) + ")/")
    hidden = path.rlike(r"(^|/)\.(?!well-known(/|$))[^/]+")
    return F.when(service, "service").when(hidden, "hidden")


#: Endings and a beginning of the names of test files, with the extensions that the beginning needs.
TEST_ENDINGS = (
    "_test.go", "_test.py", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "test.java", "tests.java", "spec.rb", "_spec.rb",
)
TEST_START, TEST_START_EXTS = "test_", ("py", "go", "rs", "cc", "cpp", "c")


def is_test_path(path: Column) -> Column:
    """Whether a path is a test by its name, or a Rust source in a folder of tests. A folder alone makes no test of others,
    nor a name's beginning one of what is no source, so nothing is hidden by where it is put."""
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    out = name.startswith(TEST_START) & F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*TEST_START_EXTS)
    for ending in TEST_ENDINGS:
        out = out | name.endswith(ending)
    return out | (name.endswith(".rs") & (low.rlike(r"(^|/)tests/") | name.isin("tests.rs", "test.rs")))


def from_folder(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder, sizes included; the size filter reaches the source. Spark's readers pass over hidden
    names by themselves, so the one hidden folder in scope is named apart."""
    jvm = spark.sparkContext._jvm
    open_too = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.well-known")
    there = open_too.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(open_too)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *([open_too.toString()] if there else [])])
    base = jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+(?=/)|^[a-z]+:(?=/)", ""), "^" + base + "/", "")
    return raw.select(path.alias("path"), F.col("length").alias("bytes"), F.col("content").alias("raw"))


def in_scope(files: DataFrame) -> DataFrame:
    """(path, ext, lang, content) of valid UTF-8 files that no exclusion names."""
    ext = extension(F.col("path"))
    shallow = F.size(F.split("path", "/")) <= MAX_DEPTH + 1
    kept = files.where((F.col("bytes") <= MAX_BYTES) & shallow & excluded(F.col("path")).isNull())
    text = kept.where(F.expr("is_valid_utf8(raw)")).withColumn("content", F.col("raw").cast("string"))
    return text.select("path", ext.alias("ext"), language(ext).alias("lang"), "content")


def oversized(files: DataFrame) -> DataFrame:
    """(path): files in scope but for their size."""
    return files.where(excluded(F.col("path")).isNull() & (F.col("bytes") > MAX_BYTES)).select("path")


def walk_counts(files: DataFrame) -> DataFrame:
    """One row: files seen, hidden, in service folders, oversized; oversized() names the last."""
    why, big = excluded(F.col("path")), F.col("bytes") > MAX_BYTES
    return files.agg(
        F.count("*").alias("files"), F.count_if(why == "hidden").alias("hidden"), F.count_if(why == "service").alias("service"),
        F.count_if(why.isNull() & big).alias("oversized"),
    )


def language(ext: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("text"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents in the role of files: the id is the path, no extension."""
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.lit("").alias("ext"), F.coalesce("text", F.lit("")).alias("content"))


def spread(files: DataFrame) -> DataFrame:
    """Files on all cores, where a scan has fewer partitions than there are cores, as one small table file gives. A scan of many
    files stays as it is."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def split_lines(content: Column) -> Column:
    """The lines of a text as an array; one carriage return at an end is no part of a line, and a line feed at the end of a file
    begins none."""
    pieces = F.split(content, "\n", -1)
    own = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.transform(own, lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def lines(files: DataFrame, above: bool = False) -> DataFrame:
    """Lines with 1-based numbers, and perhaps the line above each, null for the first, taken within the file's row."""
    if above:
        paired = lambda own: F.transform(own, lambda x, i: F.struct(x.alias("line"), F.get(own, i - 1).alias("above")))
        own = files.select("path", "ext", split_lines(F.col("content")).alias("own"))
        return own.select("path", "ext", F.posexplode(paired(F.col("own"))).alias("pos", "x")).select("path", "ext", (F.col("pos") + 1).alias("line_no"), "x.line", "x.above")
    pieces = F.split("content", "\n", -1)
    own = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    parts = files.select("path", "ext", F.posexplode(own).alias("pos", "line"))
    return parts.select("path", "ext", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))

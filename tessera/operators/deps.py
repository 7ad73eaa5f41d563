"""Dependencies: lock files, known vulnerabilities as a range join, coverage, bills of materials, licences."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.versions import version_key

#: Lock files by name, and the ecosystem of each.
LOCK_FILES = {
    "requirements.txt": "PyPI", "poetry.lock": "PyPI", "Pipfile.lock": "PyPI", "Cargo.lock": "crates.io", "package-lock.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm",
    "go.sum": "Go", "gradle.lockfile": "Maven", "pubspec.lock": "Pub", "Podfile.lock": "CocoaPods", "composer.lock": "Packagist", "Gemfile.lock": "RubyGems",
}
PURL = {"PyPI": "pypi", "crates.io": "cargo", "npm": "npm", "Go": "golang", "Maven": "maven", "Pub": "pub", "CocoaPods": "cocoapods", "Packagist": "composer", "RubyGems": "gem"}


def lock_files(files: DataFrame) -> DataFrame:
    """(path, kind, ecosystem, content) of the lock files among files."""
    names = F.create_map(*[F.lit(x) for kv in LOCK_FILES.items() for x in kv])
    kind = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.withColumn("kind", kind).where(F.col("kind").isin(*LOCK_FILES)).select("path", "kind", F.element_at(names, F.col("kind")).alias("ecosystem"), "content")


def normal_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "PyPI", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(name)


def _pairs(content: Column, pattern: str) -> Column:
    """(name, version) of all matches of a pattern with two groups."""
    names, versions = F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    return F.arrays_zip(names.alias("name"), versions.alias("version"))


#: Name and version within each kind of text lock file.
PATTERNS = {
    "requirements.txt": r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._\-]*)(?:\[[^\]]*\])?[ \t]*==[ \t]*([^\s;#,*]+)",
    "Cargo.lock": r'\[\[package\]\]\s*\nname = "([^"]+)"\s*\nversion = "([^"]+)"',
    "poetry.lock": r'\[\[package\]\]\s*\nname = "([^"]+)"\s*\nversion = "([^"]+)"',
    "yarn.lock": r'(?m)^"?((?:@[^/"\s]+/)?[^@"\s,]+)@[^\n]*:\s*\n\s+version:?\s+"?([^"\s]+)"?',
    "pnpm-lock.yaml": r"(?m)^\s+'?/?((?:@[^/'\s]+/)?[^@/'\s(]+)[@/]([0-9][^:'\s(]*)",
    "go.sum": r"(?m)^(\S+)[ \t]+v([^\s/]+)(?:/go\.mod)?[ \t]",
    "gradle.lockfile": r"(?m)^([^:#=\s]+:[^:=\s]+):([^:=\s]+)=",
    "pubspec.lock": r"(?m)^  (\w+):\n(?:    .*\n)*?    version: \"([^\"]+)\"",
    "Podfile.lock": r"(?m)^  - \"?([^\s\"(]+)\"? \(([0-9][^)]*)\)",
    "Gemfile.lock": r"(?m)^    ([^\s(]+) \(([0-9][^)]*)\)",
    "composer.lock": r'"name":\s*"([^"]+/[^"]+)",\s*"version":\s*"v?([^"]+)"',
    "Pipfile.lock": r'"([A-Za-z0-9._\-]+)":\s*\{[^{}]*"version":\s*"==([^"]+)"',
}


def text_dependencies(locks: DataFrame) -> DataFrame:
    """(ecosystem, name, version) of text lock files, each once."""
    found = F.array().cast("array<struct<name:string,version:string>>")
    for kind, pattern in PATTERNS.items():
        found = F.when(F.col("kind") == kind, _pairs(F.col("content"), pattern).cast("array<struct<name:string,version:string>>")).otherwise(found)
    rows = locks.where(F.col("kind") != "package-lock.json").select("ecosystem", F.explode(found).alias("d"))
    return rows.select("ecosystem", normal_name(F.col("ecosystem"), F.col("d.name")).alias("name"), F.col("d.version").alias("version")).distinct()


def package_lock(locks: DataFrame) -> DataFrame:
    """(ecosystem, name, version, licence) of package-lock.json, by its flat list or, in old files, its nested one, however
    deep. A file is one JSON value, so the nesting is walked where the file is."""

    def walk(found: dict) -> Iterator[tuple[str, str]]:
        todo = [found]
        while todo:
            for name, meta in todo.pop().items():
                if isinstance(meta, dict):
                    if isinstance(meta.get("version"), str):
                        yield name.lower(), meta["version"]
                    if isinstance(meta.get("dependencies"), dict):
                        todo.append(meta["dependencies"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ecosystem, content in zip(batch["ecosystem"], batch["content"], strict=True):
                try:
                    lock = json.loads(content)
                except ValueError:
                    continue
                if isinstance(lock, dict) and isinstance(lock.get("packages"), dict):
                    for path, meta in lock["packages"].items():
                        name = path.rpartition("node_modules/")[2]
                        if path and name and isinstance(meta, dict) and isinstance(meta.get("version"), str):
                            licence = meta.get("license")
                            rows.append((ecosystem, name.lower(), meta["version"], licence if isinstance(licence, str) else None))
                elif isinstance(lock, dict) and isinstance(lock.get("dependencies"), dict):
                    rows += [(ecosystem, name, version, None) for name, version in walk(lock["dependencies"])]
            yield pd.DataFrame(rows, columns=["ecosystem", "name", "version", "licence"])

    found = locks.where("kind = 'package-lock.json'").select("ecosystem", "content")
    return found.mapInPandas(run, "ecosystem string, name string, version string, licence string").distinct()


def dependencies(files: DataFrame) -> DataFrame:
    locks = lock_files(files)
    return text_dependencies(locks).unionByName(package_lock(locks).select("ecosystem", "name", "version")).distinct()


def unpinned(files: DataFrame) -> DataFrame:
    """Lines of requirements that name a range or nothing: they can't be checked."""
    lines = lock_files(files).where("kind = 'requirements.txt'").select("path", F.explode(F.split("content", r"\r?\n")).alias("line"))
    return lines.select("path", F.trim(F.regexp_replace("line", "#.*$", "")).alias("spec")).where("spec RLIKE '^[A-Za-z0-9]' AND NOT spec RLIKE '=='")


def vulnerable(deps: DataFrame, vulns: DataFrame) -> DataFrame:
    """Dependencies within a known range: introduced <= version < fixed. Without any bound the range says nothing and the
    match is uncertain, as are versions that can't be ordered. vulns is a snapshot; the join is a plain hash join on
    (ecosystem, package), whichever side Spark finds small."""
    key = lambda c: version_key(F.col("ecosystem"), F.col(c))
    v = vulns.select(F.lower("ecosystem").alias("e"), F.lower("package").alias("p"), "id", "introduced", "fixed", "severity")
    met = deps.join(v, (F.lower("ecosystem") == F.col("e")) & (F.lower("name") == F.col("p")))
    pseudo = (F.col("ecosystem") == "Go") & F.col("version").rlike(r"\d{14}-[0-9a-f]{12}$")
    unknown = (F.col("introduced").isNull() & F.col("fixed").isNull()) | pseudo
    inside = (version_key(F.col("ecosystem"), F.coalesce("introduced", F.lit("0"))) <= key("version")) & (F.col("fixed").isNull() | (key("version") < key("fixed")))
    return met.where(unknown | inside).select("id", "ecosystem", "name", "version", "severity", (~unknown).alias("certain"))


def uncovered(deps: DataFrame, vulns: DataFrame) -> DataFrame:
    """Dependencies of which the snapshot knows nothing; a package of one name in another ecosystem is another package."""
    v = vulns.select(F.lower("package").alias("p"), F.lower("ecosystem").alias("e"))
    return deps.join(v, (F.lower("name") == F.col("p")) & (F.lower("ecosystem") == F.col("e")), "left_anti")


def covered(deps: DataFrame, vulns: DataFrame) -> DataFrame:
    """Dependencies whose package the snapshot has, whatever the version."""
    v = vulns.select(F.lower("package").alias("p"), F.lower("ecosystem").alias("e"))
    return deps.join(v, (F.lower("name") == F.col("p")) & (F.lower("ecosystem") == F.col("e")), "left_semi")


def unknown_ecosystems(deps: DataFrame, vulns: DataFrame) -> DataFrame:
    return deps.join(vulns.select(F.lower("ecosystem").alias("e")), F.lower("ecosystem") == F.col("e"), "left_anti").select("ecosystem").distinct()


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in PURL.items() for x in kv])
    return F.concat(F.lit("pkg:"), F.coalesce(F.element_at(kinds, ecosystem), F.lower(ecosystem)), F.lit("/"), name, F.lit("@"), version)


def components(deps: DataFrame) -> DataFrame:
    """One JSON component a dependency, the rows of a CycloneDX 1.5 bill of materials."""
    return deps.select("ecosystem", "name", "version", purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl")).withColumn(
        "component", F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", "purl")))


def copyleft(licences: DataFrame) -> DataFrame:
    """(package, licence, severity) of copyleft licences: AGPL 3, GPL 2, LGPL 1."""
    name = F.upper("licence")
    severity = F.when(name.contains("AGPL"), 3).when(name.contains("LGPL"), 1).when(name.contains("GPL"), 2)
    return licences.withColumn("severity", severity).where("severity IS NOT NULL")

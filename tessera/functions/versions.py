"""Version strings as sortable structs, in plain expressions: no UDF is needed to compare them.

A key is (epoch, release, stage, pre): release is the dotted numbers without trailing zeros, which arrays compare element by
element, the shorter first; stage puts pre-releases before the release and post-releases after it; pre is the list of
pre-release parts, numbers before words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the stages of one release.
STAGES = (("dev", 0), ("a", 1), ("alpha", 1), ("b", 2), ("beta", 2), ("c", 3), ("rc", 3), ("pre", 3), ("preview", 3), ("post", 6), ("rev", 6), ("r", 6))
FINAL, OTHER = 5, 4


def _release(core: Column) -> Column:
    numbers = F.transform(F.split(core, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("bigint"), F.lit(0)))
    keep = F.aggregate(F.sequence(F.lit(1), F.size(numbers)), F.lit(0), lambda acc, i: F.when(F.element_at(numbers, i) != 0, i).otherwise(acc))
    return F.slice(numbers, 1, F.greatest(keep, F.lit(0)))


def _parts(text: Column) -> Column:
    """Pre-release identifiers: numbers compare as numbers and before words."""
    named = F.filter(F.split(text, r"[.\-]"), lambda x: x != "")
    one = lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("word"), F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")).alias("number"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("name"))
    return F.transform(named, one)


def semver_key(version: Column) -> Column:
    """Build data is ignored; a version with pre-release parts comes before its release."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(version), r"^[vV=]+", ""), r"\+.*$", "")
    core, pre = F.regexp_extract(plain, r"^([^-]*)", 1), F.regexp_extract(plain, r"^[^-]*-(.*)$", 1)
    return F.struct(F.lit(0).cast("bigint").alias("epoch"), _release(core).alias("release"), F.when(F.length(pre) > 0, 0).otherwise(FINAL).alias("stage"), _parts(pre).alias("pre"))


def pep440_key(version: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim(version), r"^[vV]", ""), r"\+.*$", ""))
    epoch = F.coalesce(F.regexp_extract(plain, r"^(\d+)!", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    bare = F.regexp_replace(plain, r"^\d+!", "")
    core = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)", 1)
    rest = F.regexp_replace(F.regexp_replace(bare, r"^\d+(?:\.\d+)*", ""), r"^[._\-]+", "")
    word = F.regexp_extract(rest, r"^([a-z]+)", 1)
    stage = F.lit(OTHER)
    for name, rank in STAGES:
        stage = F.when(word == name, rank).otherwise(stage)
    stage = F.when(rest == "", FINAL).when(rest.rlike(r"^\d"), 6).otherwise(stage)
    return F.struct(epoch.alias("epoch"), _release(core).alias("release"), stage.alias("stage"), _parts(F.regexp_replace(rest, r"^[a-z]+[._\-]?", "")).alias("pre"))


def version_key(ecosystem: Column, version: Column) -> Column:
    return F.when(F.lower(ecosystem) == "pypi", pep440_key(version)).otherwise(semver_key(version))

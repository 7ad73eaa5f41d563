"""Checks of markup and native interface files: one row per finding (path, rule, severity, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tags(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))


def _has(tag: Column, *attributes: str) -> Column:
    return tag.rlike(r"(?is)\s(?:" + "|".join(attributes) + r")\b")


#: rule -> (severity, extensions, how many hits a text holds).
def _checks(text: Column) -> dict[str, tuple[int, tuple[str, ...], Column]]:
    dom = ("html", "htm", "vue", "svelte", "jsx", "tsx")
    style = (*dom, "css", "scss", "less")
    count = lambda items, test: F.size(F.filter(items, test)).cast("bigint")
    once = lambda test: F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    fields = F.concat(tags(text, "input"), tags(text, "select"), tags(text, "textarea"))
    exempt = r"(?is)type\s*=\s*[\"']?(?:hidden|submit|button|reset|image)"
    viewport = F.filter(tags(text, "meta"), lambda t: t.rlike(r"(?i)name\s*=\s*[\"']?viewport"))
    numbers = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    small = lambda p, least: count(numbers(p), lambda x: x.try_cast("double") < least)
    return {
        "ui-img-without-alt": (2, dom, count(tags(text, "img"), lambda t: ~_has(t, "alt", ":alt", r"v-bind:alt"))),
        "ui-input-without-label": (2, dom, count(fields, lambda t: ~_has(t, "aria-label", "aria-labelledby", "id", "title") & ~t.rlike(exempt))),
        "ui-clickable-nonsemantic": (2, dom, count(F.concat(tags(text, "div"), tags(text, "span")), lambda t: t.rlike(r"(?i)\s(?:on-?click|@click)\b") & ~_has(t, "role", "onkeydown", "onkeyup", "onkeypress", "onKeyDown"))),
        "ui-viewport-missing": (2, dom, once(text.rlike(r"(?i)<html\b") & (F.size(viewport) == 0))),
        "ui-viewport-zoom-blocked": (2, dom, count(viewport, lambda t: t.rlike(r"(?i)user-scalable\s*=\s*(?:no|0)|maximum-scale\s*=\s*1(?:\.0)?\b"))),
        "ui-no-prefers-color-scheme": (1, style, once(text.rlike(r"(?i)color\s*:\s*#[0-9a-f]{3,8}") & ~text.contains("prefers-color-scheme"))),
        "ui-focus-outline-removed": (2, style, once(text.rlike(r"(?i)outline\s*:\s*(?:none|0)\b") & ~text.contains(":focus"))),
        "ui-touch-target-small-web": (1, style, small(r"(?i)(?:min-)?(?:height|width)\s*:\s*([0-9.]+)px", 44)),
        "ui-touch-target-small-android": (1, ("xml",), small(r'android:(?:layout_height|layout_width|minHeight|minWidth)="([0-9.]+)dp"', 48)),
        "ui-touch-target-small-ios": (1, ("swift",), small(r"(?:CGSize|CGRect|frame)\([^)\n]*?(?:width|height):\s*([0-9.]+)", 44)),
        "ui-android-image-no-contentdescription": (2, ("xml",), count(F.concat(tags(text, "ImageView"), tags(text, "ImageButton")), lambda t: ~t.contains("android:contentDescription"))),
        "ui-flutter-image-no-semantics": (2, ("dart",), count(F.regexp_extract_all(text, F.lit(r"(?s)((?:Semantics\([^;]{0,200})?\bImage(?:\.\w+)?\((?:[^()]|\([^()]*\))*\))"), F.lit(1)), lambda t: ~t.rlike("semanticLabel|excludeFromSemantics|Semantics\\("))),
        "ui-ios-accessibility-disabled": (2, ("swift",), count(F.regexp_extract_all(text, F.lit(r"(isAccessibilityElement\s*=\s*false)"), F.lit(1)), lambda t: F.lit(True))),
    }


def markup_findings(files: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    hits = []
    for rule, (severity, exts, n) in _checks(F.col("content")).items():
        if rules is None or rule in rules:
            hits.append(F.when(F.col("ext").isin(*exts), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), n.alias("n"))))
    found = files.select("path", F.explode(F.filter(F.array(*hits), lambda h: h["n"] > 0)).alias("h"))
    return found.select("path", "h.rule", "h.severity", "h.n")


def links(files: DataFrame) -> DataFrame:
    """(path, host, n): hosts that a page links to."""
    urls = F.regexp_extract_all("content", F.lit(r"href=[\"'](?:https?:)?//([^/\"'?#]+)"), F.lit(1))
    return files.select("path", F.explode(urls).alias("host")).groupBy("path", "host").agg(F.count("*").alias("n"))


def plist_findings(files: DataFrame) -> DataFrame:
    """Entitlements that are switched on in property lists."""
    on = lambda key: F.col("content").rlike(rf"<key>{key}</key>\s*<true\s*/>")
    hits = F.array_compact(F.array(F.when(on("NSAllowsArbitraryLoads"), F.struct(F.lit("mobile-ats-arbitrary-loads").alias("rule"), F.lit(3).alias("severity"))), F.when(on("get-task-allow"), F.struct(F.lit("mobile-ios-get-task-allow").alias("rule"), F.lit(2).alias("severity")))))
    return files.where(F.col("ext").isin("plist", "entitlements")).select("path", F.explode(hits).alias("f")).select("path", "f.rule", "f.severity")


def deep_links(files: DataFrame) -> DataFrame:
    """Manifests with an intent filter that views web links without verifying them."""
    filters = F.regexp_extract_all("content", F.lit(r"(?s)(<intent-filter\b.*?</intent-filter>)"), F.lit(1))
    bare = lambda x: x.contains("android.intent.action.VIEW") & x.rlike(r'android:scheme="https?"') & ~x.rlike(r'autoVerify="true"')
    return files.where("ext = 'xml'").select("path", F.lit("mobile-deeplink-no-autoverify").alias("rule"), F.size(F.filter(filters, bare)).alias("n")).where("n > 0")

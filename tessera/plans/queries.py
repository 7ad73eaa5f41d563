"""The engine's queries over the driver's tables, each with the SQL that another engine answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import evidence, extension, slug
from tessera.operators import codeintel, deps, derived, gate, graph, markup, project, rank, scan, taint, verify
from tessera.plans import oracle
from tessera.plans import rules as R
from tessera.plans.fixtures import fixture, sql
from tessera.plans.registry import registry
from tessera.plans.snippets import POSITIVE
from tessera.sources import files as src
from tessera.sources.reports import sarif_rows
from tessera.streaming.watch import session_counts, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries that work on small tables stated here, with their SQL; see `example`.
EXAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXAMPLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def example(oracle: str | None = None):
    """A query over literals: the tests run it, the catalogue doesn't hold it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        EXAMPLES[f.__name__] = f
        if oracle:
            EXAMPLE_SQL[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.spread(src.from_documents(read(spark, sf_dir, "documents")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("ext"), F.col("html").alias("content"))


#: Rules that apply to text without an extension.
PLAIN = [r for r in [*R.SECRET, *R.PII, *R.SMELL] if not r.exts]
LINES, FINDINGS_SQL = oracle.LINES, oracle.FINDINGS


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir)
    return scan.scan(files, src.lines(files), PLAIN)


@query(FINDINGS_SQL + "SELECT path, line_no, rule, severity, cap FROM found")
def findings(spark, sf_dir):
    return doc_findings(spark, sf_dir).select("path", "line_no", "rule", "severity", "cap")


@query(FINDINGS_SQL + "SELECT severity, count(*) AS n, count(DISTINCT path) AS files FROM found GROUP BY severity")
def findings_by_severity(spark, sf_dir):
    return doc_findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query(FINDINGS_SQL + "SELECT cap, count(*) AS n, count(*) FILTER (WHERE severity >= 3) AS n_high FROM found GROUP BY cap")
def findings_by_source(spark, sf_dir):
    return gate.by_source(doc_findings(spark, sf_dir))


@query(FINDINGS_SQL + oracle.SCORE)
def gate_score(spark, sf_dir):
    found = gate.keep_first(doc_findings(spark, sf_dir)).withColumn("verified", F.lit(True))
    return gate.verdict(gate.bucketed(found))


@query(FINDINGS_SQL + """SELECT rule, severity, path, line_no, list_extract(['note', 'note', 'warning', 'error', 'error'], severity + 1) AS level,
       list_extract([10, 25, 55, 85, 100], severity + 1) AS rank FROM found""")
def sarif(spark, sf_dir):
    return sarif_rows(doc_findings(spark, sf_dir))


@query(FINDINGS_SQL + oracle.VERIFIED)
def verified_findings(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    lines = src.lines(files, above=True)
    return verify.verify(scan.scan(files, lines, PLAIN), lines, parsers=False).select("path", "line_no", "rule", "severity", "verified", "refuted_by")


_LONG = next(r for r in R.SECRET if r.id == "generic-secret-long")
_LONG_SQL = next(pattern for _, rule, _, pattern, _, _ in oracle.PLAIN if rule == "generic-secret-long")


@query(f"""WITH {LINES}, v AS (SELECT path, line_no, regexp_extract(line, {oracle.quoted(_LONG_SQL)}, 1) AS value FROM lines WHERE strlen(line) <= 2000)
SELECT path, line_no, value, round({oracle.bits('value')}, 6) AS bits FROM v WHERE value <> '' AND {oracle.bits('value')} >= 3.0""")
def secret_entropy(spark, sf_dir):
    out = scan.secrets_by_entropy(src.lines(doc_files(spark, sf_dir)), _LONG.pattern, _LONG.bits)
    return out.select("path", "line_no", "value", F.round("bits", 6).alias("bits"))


@query(FINDINGS_SQL + "SELECT rule, count(*) AS n FROM found WHERE cap = 'security.scan/pii' GROUP BY rule")
def pii_counts(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    some = [r for r in R.PII if not r.exts]
    return scan.scan(files, src.lines(files), some).groupBy("rule").agg(F.count("*").alias("n"))


_WINDOW = R.Rule("demo", "split-of-the", 1, "window", (), r"(?i)\bof\.\n[^\n]{0,60}\bthe\b", 3)


@query(f"""WITH {LINES}, f AS (SELECT path, line_no, array_to_string(list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), chr(10)) AS frame FROM lines),
h AS (SELECT path, line_no, frame, regexp_extract(frame, '(?is)^(.*?)(?:\\bof\\.\\n[^\\n]{{0,60}}\\bthe\\b)', 1) AS head FROM f
      WHERE strlen(frame) <= 6000 AND regexp_matches(frame, '(?i)\\bof\\.\\n[^\\n]{{0,60}}\\bthe\\b'))
SELECT DISTINCT path, CAST(line_no + length(head) - length(replace(head, chr(10), '')) AS INTEGER) AS line_no FROM h""")
def window_rule(spark, sf_dir):
    return scan.window_findings(doc_files(spark, sf_dir), [_WINDOW], {"demo": 0}).select("path", "line_no")


@query(f"WITH {LINES} SELECT (SELECT count(*) FROM documents) AS files_scanned, count(*) FILTER (WHERE strlen(line) > 2000) AS long_lines_out_of_scope, count(*) AS n_lines FROM lines")
def long_lines(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    return scan.coverage(files, src.lines(files))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '([\p{L}_][\p{L}\p{N}_]+)', 1)) AS ident FROM documents)
SELECT ident, count(*) AS n FROM w GROUP BY ident ORDER BY n DESC, ident LIMIT 100""")
def ident_freq(spark, sf_dir):
    """The hundred most frequent identifiers; counts cover all of them."""
    return codeintel.identifiers(doc_files(spark, sf_dir)).orderBy(F.desc("n"), "ident").limit(100)


_METRICS = oracle.METRICS


@query(_METRICS + "SELECT path, n_lines, complexity FROM m ORDER BY complexity DESC, path LIMIT 10")
def complexity_topk(spark, sf_dir):
    return codeintel.top_complex(codeintel.file_metrics(src.lines(doc_files(spark, sf_dir))))


@query(_METRICS + "SELECT count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS lines, CAST(sum(complexity) AS BIGINT) AS complexity, max(complexity) AS most FROM m")
def metric_totals(spark, sf_dir):
    return codeintel.metric_totals(codeintel.file_metrics(src.lines(doc_files(spark, sf_dir))))


@query(_METRICS + """SELECT path, 'long-file' AS rule, 1 AS severity FROM m WHERE n_lines > 400 UNION ALL SELECT path, 'high-complexity', 2 FROM m WHERE complexity > 50""")
def metric_findings(spark, sf_dir):
    return codeintel.metric_findings(codeintel.file_metrics(src.lines(doc_files(spark, sf_dir))))


@query(f"""WITH {LINES}, s AS (SELECT path, line_no, length(replace(regexp_extract(line, '^([ \\t]*)', 1), chr(9), '    ')) AS indent FROM lines WHERE trim(line) <> ''),
u AS (SELECT path, min(indent) AS unit FROM s WHERE indent > 0 GROUP BY path),
d AS (SELECT s.path, line_no, CAST(floor(indent / coalesce(unit, 1)) AS INTEGER) AS depth FROM s LEFT JOIN u ON s.path = u.path)
SELECT path, max(depth) AS depth, arg_max(line_no, depth * 1000000 - line_no) AS line_no FROM d GROUP BY path""")
def deepest_line(spark, sf_dir):
    return codeintel.deepest(src.lines(doc_files(spark, sf_dir)))


@query(f"WITH {LINES} SELECT regexp_extract(line, '(?i)(all rights reserved|public license|creative commons|mit license|apache license)', 1) AS licence, count(*) AS n FROM lines WHERE regexp_matches(line, '(?i)all rights reserved|public license|creative commons|mit license|apache license') GROUP BY 1")
def licence_lines(spark, sf_dir):
    p = "(?i)(all rights reserved|public license|creative commons|mit license|apache license)"
    lines = src.lines(doc_files(spark, sf_dir)).where(F.col("line").rlike(p))
    return lines.groupBy(F.regexp_extract("line", p, 1).alias("licence")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"WITH {LINES} SELECT path, line_no, trim(line)[1:120] AS evidence FROM lines WHERE regexp_matches(line, '[0-9]{{16}}')")
def evidence_lines(spark, sf_dir):
    return src.lines(doc_files(spark, sf_dir)).where(F.col("line").rlike("[0-9]{16}")).select("path", "line_no", evidence(F.col("line")).alias("evidence"))


# Markup


@query("""SELECT CAST(page_id AS VARCHAR) AS path, 'ui-viewport-missing' AS rule, 2 AS severity, CAST(1 AS BIGINT) AS n FROM pages
WHERE regexp_matches(html, '(?i)<html\\b') AND len(list_filter(regexp_extract_all(html, '(?is)(<meta\\b[^>]*>)', 1), lambda t: regexp_matches(t, '(?i)name\\s*=\\s*["'']?viewport'))) = 0""")
def viewport_missing(spark, sf_dir):
    return markup.markup_findings(page_files(spark, sf_dir), ("ui-viewport-missing",))


_ALL_PAGES = f"WITH {sql('pages_made')}, all_pages AS (SELECT CAST(page_id AS VARCHAR) AS path, html FROM pages UNION ALL SELECT path, content FROM pages_made)"


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's pages and two that are made to hold what it has not."""
    return page_files(spark, sf_dir).unionByName(fixture(spark, "pages_made"))


@example(_ALL_PAGES + """, t AS (SELECT path, len(list_filter(regexp_extract_all(html, '(?is)(<img\\b[^>]*>)', 1), lambda t: NOT regexp_matches(t, '(?is)\\s(?:alt|:alt|v-bind:alt)\\b'))) AS n FROM all_pages)
SELECT path, 'ui-img-without-alt' AS rule, 2 AS severity, CAST(n AS BIGINT) AS n FROM t WHERE n > 0""")
def img_no_alt(spark, sf_dir):
    return markup.markup_findings(all_pages(spark, sf_dir), ("ui-img-without-alt",))


@query(_ALL_PAGES + """, f AS (
  SELECT path, 'ui-viewport-missing' AS rule, 2 AS severity, CASE WHEN regexp_matches(html, '(?i)<html\\b') AND NOT regexp_matches(html, '(?is)<meta\\b[^>]*name\\s*=\\s*["'']?viewport') THEN 1 ELSE 0 END AS n FROM all_pages
  UNION ALL SELECT path, 'ui-viewport-zoom-blocked', 2, len(regexp_extract_all(html, '(?is)<meta\\b[^>]*user-scalable=no[^>]*>')) FROM all_pages
  UNION ALL SELECT path, 'ui-img-without-alt', 2, len(list_filter(regexp_extract_all(html, '(?is)<img\\b[^>]*>'), lambda t: NOT regexp_matches(t, '(?is)\\salt\\b'))) FROM all_pages
  UNION ALL SELECT path, 'ui-input-without-label', 2, len(list_filter(regexp_extract_all(html, '(?is)<(?:input|select|textarea)\\b[^>]*>'), lambda t: NOT regexp_matches(t, '(?is)\\s(?:aria-label|aria-labelledby|id|title)\\b|type\\s*=\\s*["'']?(?:hidden|submit|button|reset|image)'))) FROM all_pages
  UNION ALL SELECT path, 'ui-clickable-nonsemantic', 2, len(list_filter(regexp_extract_all(html, '(?is)<(?:div|span)\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\sonclick\\b') AND NOT regexp_matches(t, '(?i)\\s(?:role|onkeydown|onkeyup|onkeypress)\\b'))) FROM all_pages)
SELECT path, rule, severity, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""")
def markup_all(spark, sf_dir):
    return markup.markup_findings(all_pages(spark, sf_dir))


@example(_ALL_PAGES + """, f AS (
  SELECT path, 'ui-viewport-missing' AS rule, 2 AS severity, CASE WHEN regexp_matches(html, '(?i)<html\\b') AND NOT regexp_matches(html, '(?is)<meta\\b[^>]*name\\s*=\\s*["'']?viewport') THEN 1 ELSE 0 END AS n FROM all_pages
  UNION ALL SELECT path, 'ui-viewport-zoom-blocked', 2, len(regexp_extract_all(html, '(?is)<meta\\b[^>]*user-scalable=no[^>]*>')) FROM all_pages
  UNION ALL SELECT path, 'ui-img-without-alt', 2, len(list_filter(regexp_extract_all(html, '(?is)<img\\b[^>]*>'), lambda t: NOT regexp_matches(t, '(?is)\\salt\\b'))) FROM all_pages
  UNION ALL SELECT path, 'ui-input-without-label', 2, len(list_filter(regexp_extract_all(html, '(?is)<(?:input|select|textarea)\\b[^>]*>'), lambda t: NOT regexp_matches(t, '(?is)\\s(?:aria-label|aria-labelledby|id|title)\\b|type\\s*=\\s*["'']?(?:hidden|submit|button|reset|image)'))) FROM all_pages
  UNION ALL SELECT path, 'ui-clickable-nonsemantic', 2, len(list_filter(regexp_extract_all(html, '(?is)<(?:div|span)\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\sonclick\\b') AND NOT regexp_matches(t, '(?i)\\s(?:role|onkeydown|onkeyup|onkeypress)\\b'))) FROM all_pages)
SELECT path, rule, severity, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""")
def markup_made(spark, sf_dir):
    return markup.markup_findings(all_pages(spark, sf_dir))


@example(_ALL_PAGES + """, u AS (SELECT path, unnest(regexp_extract_all(html, 'href=["''](?:https?:)?//([^/"''?#]+)', 1)) AS host FROM all_pages)
SELECT path, host, count(*) AS n FROM u GROUP BY path, host""")
def links_outbound(spark, sf_dir):
    return markup.links(all_pages(spark, sf_dir))


# Vectors


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) DESC, vec_id LIMIT 6""")
def cosine_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").select("embedding").first()
    return rank.nearest(vectors, q[0]).withColumn("score", F.round("score", 6))


# Events


@query("""WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started FROM s GROUP BY user_id, session""")
def events_session(spark, sf_dir):
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(frame))
    new = F.when(F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0)
    return e.withColumn("session", F.sum(new).over(frame)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windows(spark, sf_dir):
    return windowed_counts(read(spark, sf_dir, "events"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def events_props(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


# Verdicts over fixtures


@example(f"""WITH {sql('found')}, k AS (SELECT *, row_number() OVER (PARTITION BY rule, path, line_no ORDER BY cap_ord) AS n FROM found)
SELECT rule, severity, path, line_no, cap FROM k WHERE n = 1""")
def dedup_first(spark, sf_dir):
    found = fixture(spark, "found").withColumns({"phase": F.lit(0), "rule_ord": F.lit(0)})
    return gate.keep_first(found).select("rule", "severity", "path", "line_no", "cap")


@example(f"""WITH {sql('found')}, {oracle.CATEGORIES}
SELECT category, count(found.rule) AS n, count(*) FILTER (WHERE found.severity >= 3) AS n_high FROM c LEFT JOIN found ON c.rule = found.rule GROUP BY category""")
def owasp_matrix(spark, sf_dir):
    return gate.matrix(fixture(spark, "found"))


@example(f"""WITH {sql('checks')} SELECT count(*) FILTER (WHERE state = 'ran') AS n_ran, count(*) FILTER (WHERE state = 'skipped') AS n_skipped, count(*) FILTER (WHERE state = 'failed') AS n_failed,
100.0 * count(*) FILTER (WHERE state = 'ran') / count(*) FILTER (WHERE state IN ('ran', 'skipped')) AS rigor FROM checks""")
def rigor(spark, sf_dir):
    return gate.rigor(fixture(spark, "checks")).withColumn("rigor", F.col("rigor").cast("double"))


_AXIS_SQL = f"WITH {sql('found', 'checks')}, {oracle.AXES}\n"


@example(_AXIS_SQL + "SELECT * FROM states")
def dod_axes(spark, sf_dir):
    return gate.axis_states(fixture(spark, "found"), fixture(spark, "checks"), gate.axes(spark))


@example(_AXIS_SQL + "SELECT bool_and(NOT hard OR state = 'confirmed') AS confirmed, count(*) FILTER (WHERE hard AND state = 'failed') AS hard_failed, count(*) FILTER (WHERE hard AND state = 'not run') AS hard_not_run FROM states")
def dod_verdict(spark, sf_dir):
    return gate.done(gate.axis_states(fixture(spark, "found"), fixture(spark, "checks"), gate.axes(spark)))


@query("""WITH p AS (SELECT l.quality = 0 AS actual, regexp_matches(d.text, '!!|[#*$%&]{3}') AS predicted FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted AND NOT actual) AS fp, count(*) FILTER (WHERE NOT predicted AND actual) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT actual) AS tn FROM p)
SELECT tp, fp, fn, tn, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn) - fp / (fp + tn), 6) AS youden FROM c""")
def confusion(spark, sf_dir):
    pairs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id")
    out = gate.confusion(pairs.select((F.col("quality") == 0).alias("actual"), F.col("text").rlike("!!|[#*$%&]{3}").alias("predicted")))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "precision", "youden")])


@example(f"""WITH {sql('marks')}, c AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS above FROM marks)
SELECT path, line_no FROM c WHERE line LIKE 'bad%' AND NOT (line LIKE '%tessera:ignore%' OR coalesce(above, '') LIKE '%tessera:ignore%')""")
def ignore_above(spark, sf_dir):
    m = fixture(spark, "marks")
    found = m.where("line LIKE 'bad%'").select("path", "line_no", F.lit("bad").alias("rule"), F.lit("x").alias("cap"))
    return verify.verify(found, m).where("verified").select("path", "line_no")


@example(f"""WITH {sql('marks')} SELECT path, line_no, last_value(nullif(regexp_extract(line, '^type\\s+(\\w+)\\s+struct', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS type FROM marks""")
def carried_type(spark, sf_dir):
    return codeintel.carried_type(fixture(spark, "marks")).select("path", "line_no", "type")


@example(f"""WITH {sql('marks')} SELECT path, line_no, CAST(sum((length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', '')))) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) AS depth FROM marks""")
def brace_depth(spark, sf_dir):
    return codeintel.brace_depth(fixture(spark, "marks")).select("path", "line_no", "depth")


# Dependencies


_KEY = lambda c: f"list_transform(string_split({c}, '.'), lambda x: CAST(x AS BIGINT))"


@example(f"""WITH {sql('deps', 'vulns')} SELECT v.id, d.ecosystem, d.name, d.version, v.severity, true AS certain FROM deps d JOIN vulns v ON lower(d.ecosystem) = lower(v.ecosystem) AND lower(d.name) = lower(v.package)
WHERE {_KEY('v.introduced')} <= {_KEY('d.version')} AND {_KEY('d.version')} < {_KEY('v.fixed')}""")
def osv_range(spark, sf_dir):
    return deps.vulnerable(fixture(spark, "deps"), fixture(spark, "vulns"))


@example(f"WITH {sql('deps', 'vulns')} SELECT ecosystem, name, version FROM deps d WHERE NOT EXISTS (SELECT 1 FROM vulns v WHERE lower(v.package) = lower(d.name) AND lower(v.ecosystem) = lower(d.ecosystem))")
def osv_uncovered(spark, sf_dir):
    return deps.uncovered(fixture(spark, "deps"), fixture(spark, "vulns"))


@example(f"WITH {sql('deps', 'vulns')} SELECT DISTINCT ecosystem FROM deps WHERE lower(ecosystem) NOT IN (SELECT lower(ecosystem) FROM vulns)")
def osv_ecosystems(spark, sf_dir):
    return deps.unknown_ecosystems(fixture(spark, "deps"), fixture(spark, "vulns"))


@example(f"""WITH {sql('deps')} SELECT name, version, 'pkg:' || CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'npm' THEN 'npm' WHEN 'Go' THEN 'golang' WHEN 'crates.io' THEN 'cargo' ELSE lower(ecosystem) END || '/' || name || '@' || version AS purl FROM deps""")
def sbom(spark, sf_dir):
    return deps.components(fixture(spark, "deps")).select("name", "version", "purl")


@example(f"""WITH {sql('licences')} SELECT package, licence, CASE WHEN upper(licence) LIKE '%AGPL%' THEN 3 WHEN upper(licence) LIKE '%LGPL%' THEN 1 ELSE 2 END AS severity FROM licences WHERE upper(licence) LIKE '%GPL%'""")
def licence_risk(spark, sf_dir):
    return deps.copyleft(fixture(spark, "licences"))


@example(f"WITH {sql('licences')} SELECT licence, count(*) AS n FROM licences GROUP BY licence")
def licence_histogram(spark, sf_dir):
    return fixture(spark, "licences").groupBy("licence").agg(F.count("*").alias("n"))


# Structure


@example(f"WITH {sql('api_old', 'api_new')} (SELECT key, 'removed' AS change FROM (SELECT key FROM api_old EXCEPT SELECT key FROM api_new)) UNION ALL (SELECT key, 'added' FROM (SELECT key FROM api_new EXCEPT SELECT key FROM api_old))")
def api_break(spark, sf_dir):
    return codeintel.api_changes(fixture(spark, "api_old"), fixture(spark, "api_new"))


@example(f"""WITH {sql('edges', 'layers')} SELECT DISTINCT src, dst FROM edges e WHERE src <> dst AND src IN (SELECT module FROM layers) AND dst IN (SELECT module FROM layers)
AND NOT EXISTS (SELECT 1 FROM layers l WHERE l.module = e.src AND l.allowed = e.dst)""")
def layers(spark, sf_dir):
    return codeintel.layer_violations(fixture(spark, "edges"), fixture(spark, "layers"))


@example("""SELECT * FROM (VALUES ('FORBID', 'eval(', 'a.py'), ('REQUIRE', 'LICENSE', NULL), ('REQUIRE_EACH', 'class', 'a.py'), ('REQUIRE_EACH', 'class', 'b.js')) AS t(directive, needle, path)""")
def constitution(spark, sf_dir):
    return codeintel.constitution(fixture(spark, "code"), fixture(spark, "constitution"))


@example(f"""WITH {sql('defs', 'calls')} SELECT name, path FROM defs WHERE NOT entry AND NOT dispatched AND name NOT IN (SELECT callee FROM calls WHERE caller <> callee)
AND name NOT IN (SELECT name FROM defs GROUP BY name HAVING count(*) > 1)""")
def unreachable(spark, sf_dir):
    return graph.unreachable(fixture(spark, "defs"), fixture(spark, "calls"))


@example(f"WITH {sql('defs', 'calls')} SELECT DISTINCT callee FROM calls WHERE callee NOT IN (SELECT name FROM defs)")
def unresolved_calls(spark, sf_dir):
    return graph.unresolved(fixture(spark, "calls"), fixture(spark, "defs"))


_CLOSURE = f"WITH RECURSIVE {sql('edges')}, r(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src)"


@example(f"WITH RECURSIVE {sql('edges')}, r(node) AS (SELECT 'f' UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.node) SELECT node FROM r WHERE node <> 'f'")
def blast_radius(spark, sf_dir):
    return graph.blast_radius(spark.createDataFrame([("f",)], "node string"), fixture(spark, "edges"))


@example(_CLOSURE + """, m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst),
c AS (SELECT src AS node, least(min(dst), src) AS component FROM m GROUP BY src)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def scc(spark, sf_dir):
    return graph.cycles(fixture(spark, "edges"))


@example(f"""WITH {sql('edges')}, e AS (SELECT DISTINCT src, dst FROM edges) SELECT 'graph LR' || chr(10) || string_agg('  "' || src || '" --> "' || dst || '"', chr(10) ORDER BY src, dst) AS diagram FROM e""")
def diagram(spark, sf_dir):
    return graph.mermaid(fixture(spark, "edges"))


@example(f"""WITH {sql('commits')}, t AS (SELECT ord, CASE WHEN regexp_extract(message, '^(\\w+)(?:\\([^)]*\\))?!?:\\s*', 1) = '' THEN 'other' ELSE regexp_extract(message, '^(\\w+)(?:\\([^)]*\\))?!?:\\s*', 1) END AS type,
regexp_replace(message, '^\\w+(?:\\([^)]*\\))?!?:\\s*', '') AS text FROM commits) SELECT type, count(*) AS n, string_agg(text, '; ' ORDER BY ord) AS messages FROM t GROUP BY type""")
def release_notes(spark, sf_dir):
    return codeintel.commits_by_type(fixture(spark, "commits")).withColumn("messages", F.array_join("messages", "; "))


@example("""SELECT * FROM (VALUES ('a.py', 3, 'debt-marker', 0, 'quality.check/smell'), ('a.py', 4, 'dangerous-exec', 3, 'security.scan/owasp'), ('b.js', 2, 'xss-sink', 2, 'security.scan/owasp'),
  ('b.js', 2, 'raw-innerhtml', 3, 'security.scan/injection'), ('c.yaml', 2, 'host-network', 3, 'security.scan/iac'), ('c.yaml', 3, 'image-latest-tag', 2, 'security.scan/iac')) AS t(path, line_no, rule, severity, cap)""")
def code_findings(spark, sf_dir):
    files = fixture(spark, "code")
    return scan.scan(files, src.lines(files), R.ALL).select("path", "line_no", "rule", "severity", "cap")


_EXPECTED = """SELECT * FROM (VALUES ('v.py', 'view', 3, 'sast/taint-command-exec', 4, false), ('a.js', 'f', 3, 'sast/taint-sql', 3, false), ('b.go', 'h', 3, 'sast/taint-path', 3, false), ('c.c', 'k', 4, 'sast/taint-command-exec', 4, false),
  ('c.c', 'k', 6, 'sast/double-free', 4, false), ('lib/D.java', 'm', 4, 'sast/taint-command-exec', 4, false), ('lib/D.java', 'm', 5, 'pdn-log-dynamic', 3, false)) AS t(path, func, line_no, rule, severity, verified)"""


@example(_EXPECTED + " WHERE path = 'v.py'")
def taint_python(spark, sf_dir):
    return taint.taint_findings(fixture(spark, "sources").where("ext = 'py'"))


@example(_EXPECTED)
def taint_languages(spark, sf_dir):
    return taint.taint_findings(fixture(spark, "sources"))


@example("SELECT * FROM (VALUES ('view', 'run'), ('f', 'g'), ('lonely', 'h')) AS t(src, dst)")
def call_graph(spark, sf_dir):
    events = taint.fold(fixture(spark, "sources"))
    return graph.call_edges(taint.calls(events), taint.definitions(events))


@example(f"""WITH RECURSIVE {sql('changed')}, d AS (SELECT * FROM (VALUES ('view', 'v.py'), ('run', 'v.py'), ('f', 'a.js'), ('g', 'a.js'), ('h', 'b.go'), ('lonely', 'b.go'), ('k', 'c.c'), ('m', 'lib/D.java')) AS t(name, path)),
c AS (SELECT * FROM (VALUES ('view', 'run'), ('f', 'g'), ('lonely', 'h')) AS t(src, dst)), centre AS (SELECT name FROM d WHERE path IN (SELECT path FROM changed)),
r(name) AS (SELECT name FROM centre UNION SELECT c.src FROM r JOIN c ON c.dst = r.name)
SELECT name, CASE WHEN name IN (SELECT name FROM centre) THEN 'changed' ELSE 'affected' END AS role FROM r""")
def diff_scope(spark, sf_dir):
    events = taint.fold(fixture(spark, "sources"))
    return graph.diff_scope(fixture(spark, "changed"), taint.definitions(events), taint.calls(events))


@example("""SELECT * FROM (VALUES ('(root)', 4, 27, 'c,go,javascript,python', 7), ('lib', 1, 7, 'java', 1)) AS t(folder, files, lines, langs, symbols)""")
def folder_map(spark, sf_dir):
    lines = src.lines(fixture(spark, "sources"))
    return codeintel.folder_map(lines, codeintel.symbols(lines)).withColumn("langs", F.array_join("langs", ","))


@example("""SELECT * FROM (VALUES ('language', 'c', 1, 1), ('language', 'go', 2, 0), ('language', 'java', 1, 0), ('language', 'javascript', 2, 0), ('language', 'python', 2, 2)) AS t(level, name, n, n_exported)""")
def symbol_counts(spark, sf_dir):
    return codeintel.symbol_counts(codeintel.symbols(src.lines(fixture(spark, "sources")))).where("level = 'language'")


@example(f"""WITH {sql('deps', 'vulns')} SELECT ecosystem, name, version FROM deps d WHERE EXISTS (SELECT 1 FROM vulns v WHERE lower(v.package) = lower(d.name) AND lower(v.ecosystem) = lower(d.ecosystem))""")
def osv_covered(spark, sf_dir):
    return deps.covered(fixture(spark, "deps"), fixture(spark, "vulns"))


@query(_METRICS + """, f AS (SELECT 'long-file' AS rule, 1 AS severity, path FROM m WHERE n_lines > 400 UNION ALL SELECT 'high-complexity', 2, path FROM m WHERE complexity > 50)
SELECT rule, severity, path, true AS verified, 'quality.check/complexity' AS cap, CASE WHEN severity >= 3 THEN 'blocking' ELSE 'advisory' END AS bucket FROM f""")
def derived_findings(spark, sf_dir):
    """Metrics of files as findings, in the bucket that the gate gives them."""
    found = derived.metrics(codeintel.file_metrics(src.lines(doc_files(spark, sf_dir))))
    return gate.bucketed(found).drop("confidence", "line_no")


@query(FINDINGS_SQL + oracle.SCORE.replace("SELECT count(*) FILTER", ", s AS (SELECT count(*) FILTER", 1) + """) SELECT CASE WHEN passed THEN 'Ready to ship. Quality ' || score || '/100, 5 checks passed, no blockers.'
  ELSE 'Not ready to ship. Quality ' || score || '/100, ' || blocking || ' blocker(s) need your decision.' END || ' Tests: not run.' AS headline FROM s""")
def headline(spark, sf_dir):
    verdict = gate_score(spark, sf_dir)
    checks = fixture(spark, "checks")
    tests = derived.test_status(checks.where("id <> 'verify/test'"), doc_findings(spark, sf_dir), serious=True)
    return derived.headline(verdict, checks, tests)


@example(f"WITH {sql('commits')} SELECT ord, trim(regexp_replace(lower(message), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM commits")
def slugs(spark, sf_dir):
    return fixture(spark, "commits").select("ord", slug(F.col("message")).alias("slug"))


# A small project


def shop_lines(spark: SparkSession) -> DataFrame:
    return src.lines(fixture(spark, "shop"))


@example("""SELECT * FROM (VALUES ('PyPI', 'requests', '2.18.0'), ('PyPI', 'foo-bar', '1'), ('crates.io', 'foo', '1.2.3'), ('npm', 'g', '1.0.0')) AS t(ecosystem, name, version)""")
def lock_dependencies(spark, sf_dir):
    return deps.dependencies(fixture(spark, "shop"))


@example("SELECT * FROM (VALUES ('requirements.txt', 'flask>=2')) AS t(path, spec)")
def unpinned(spark, sf_dir):
    return deps.unpinned(fixture(spark, "shop"))


@example("SELECT * FROM (VALUES ('g', 'GPL-3.0', 2)) AS t(package, licence, severity)")
def licences_of_locks(spark, sf_dir):
    found = deps.package_lock(deps.lock_files(fixture(spark, "shop"))).where("licence IS NOT NULL")
    return deps.copyleft(found.select(F.col("name").alias("package"), "licence"))


@example("SELECT * FROM (VALUES ('Go', 1), ('Python', 1)) AS t(stack, n)")
def stacks(spark, sf_dir):
    return project.stacks(fixture(spark, "shop"))


@example("SELECT 'app/main.py' AS path")
def entry_points(spark, sf_dir):
    return project.entry_points(shop_lines(spark))


@example("""SELECT * FROM (VALUES ('image', 'base:1', 'Dockerfile'), ('service', 'web', 'c.yml'), ('service', 'db', 'c.yml'), ('object', 'Service/web', 'k.yaml')) AS t(kind, name, path)""")
def containers(spark, sf_dir):
    return project.containers(shop_lines(spark))


@example("""SELECT * FROM (VALUES ('app', 'https://h.example/x', 'http', 'app/main.py', 9), ('core', 'https://api.example.com/v1', 'http', 'core/a.go', 8)) AS t(module, target, protocol, path, line_no)""")
def outbound_calls(spark, sf_dir):
    return project.outbound_calls(shop_lines(spark))


@example("""SELECT * FROM (VALUES ('model', 'Shop', 'app/main.py', 3), ('service', 'https://h.example/x', 'app/main.py', 9), ('route', '/x', 'app/util/tool.py', 3), ('env', 'KEY', 'app/util/tool.py', 8), ('service', 'https://api.example.com/v1', 'core/a.go', 8)) AS t(category, value, path, line_no)""")
def surface(spark, sf_dir):
    return codeintel.surface(shop_lines(spark))


@example("""SELECT * FROM (VALUES ('app', 'app/util'), ('app/util', 'app'), ('core', 'app/util')) AS t(src, dst)""")
def module_edges(spark, sf_dir):
    return codeintel.imports(shop_lines(spark))


@example("""SELECT * FROM (VALUES ('import-cycle', 2, 'app', CAST(true AS BOOLEAN), 'quality.check/cycles')) AS t(rule, severity, path, verified, cap)""")
def import_cycles(spark, sf_dir):
    return derived.import_cycles(graph.cycles(codeintel.imports(shop_lines(spark)))).drop("line_no")


@example("""SELECT * FROM (VALUES ('app', 3, 3, 'python', 'Shop,main,helper'), ('app/util', 1, 1, 'python', 'route'), ('core', 1, 1, 'go', 'Alpha'), ('(root)', 2, 0, 'rust', '')) AS t(module, n, n_exported, langs, first_exports)""")
def module_cards(spark, sf_dir):
    return codeintel.module_cards(codeintel.symbols(shop_lines(spark))).withColumns({"langs": F.array_join("langs", ","), "first_exports": F.array_join("first_exports", ",")})


@example("""SELECT * FROM (VALUES ('app/main.py', 3, 'python', 'class', 'Shop', true), ('app/main.py', 7, 'python', 'function', 'main', true), ('app/main.py', 11, 'python', 'function', 'helper', true), ('app/util/tool.py', 4, 'python', 'function', 'route', true),
  ('core/a.go', 7, 'go', 'function', 'Alpha', true), ('lib.rs', 1, 'rust', 'function', 'a', false), ('lib.rs', 5, 'rust', 'function', 'b', false)) AS t(path, line_no, lang, kind, name, exported)""")
def symbols(spark, sf_dir):
    return codeintel.symbols(shop_lines(spark))


@example("""SELECT * FROM (VALUES ('app/main.py', 3, 'Shop'), ('app/util/tool.py', 4, 'route'), ('core/a.go', 7, 'Alpha')) AS t(path, line_no, name)""")
def dead_exports(spark, sf_dir):
    return codeintel.dead_exports(codeintel.symbols(shop_lines(spark)), fixture(spark, "shop"))


@example("SELECT * FROM (VALUES (5, 1, CAST(20 AS DOUBLE))) AS t(n, n_documented, percent)")
def documented_share(spark, sf_dir):
    lines = shop_lines(spark)
    return codeintel.documented(lines, codeintel.symbols(lines))


@example("SELECT * FROM (VALUES ('undocumented-api', 0, 'app/main.py', 3, true, 'quality.check/undocumented')) AS t(rule, severity, path, line_no, verified, cap)")
def undocumented_finding(spark, sf_dir):
    lines = shop_lines(spark)
    return derived.undocumented(lines, codeintel.symbols(lines))


@example("SELECT * FROM (VALUES ('app/main.py', 8), ('app/main.py', 11)) AS t(path, line_no)")
def find_usages(spark, sf_dir):
    return codeintel.find_usages(shop_lines(spark), "helper")[0].select("path", "line_no")


@example("SELECT * FROM (VALUES ('app/util/tool.py', 7, 'taint-llm-output-exec', 4)) AS t(path, line_no, rule, severity)")
def model_output(spark, sf_dir):
    return project.model_output_findings(shop_lines(spark))


@example("SELECT * FROM (VALUES ('lib.rs', 4), ('lib.rs', 5), ('lib.rs', 6)) AS t(path, line_no)")
def rust_test_regions(spark, sf_dir):
    return project.rust_test_regions(shop_lines(spark))


@example("SELECT * FROM (VALUES ('mobile', 'android', '(root)')) AS t(kind, platform, folder)")
def platforms(spark, sf_dir):
    return project.platforms(fixture(spark, "shop"))


@example("SELECT * FROM (VALUES ('Go', 'go test -cover ./...'), ('Python', 'python -m pytest --cov')) AS t(stack, command)")
def coverage_tools(spark, sf_dir):
    return project.coverage_tool(fixture(spark, "shop"))


@example("SELECT * FROM (VALUES ('AndroidManifest.xml', 'mobile-deeplink-no-autoverify', 1)) AS t(path, rule, n)")
def deep_links(spark, sf_dir):
    return markup.deep_links(fixture(spark, "shop"))


@example("SELECT * FROM (VALUES ('i.plist', 'mobile-ios-get-task-allow', 2)) AS t(path, rule, severity)")
def plist_entitlements(spark, sf_dir):
    return markup.plist_findings(fixture(spark, "shop"))


@example("SELECT * FROM (VALUES ('Shop', 'app/main.py')) AS t(name, path)")
def glossary(spark, sf_dir):
    return project.glossary(codeintel.symbols(shop_lines(spark)))


@example("SELECT * FROM (VALUES ('v.py', 4, 'sast/dynamic-exec', 3, true), ('v.py', 7, 'sast/dynamic-exec', 3, true), ('c.c', 4, 'sast/dynamic-exec', 3, true)) AS t(path, line_no, rule, severity, verified)")
def structural_calls(spark, sf_dir):
    return taint.structural_findings(fixture(spark, "sources"))


@example(f"""WITH {sql('walked')}, w AS (SELECT *, CASE WHEN regexp_matches(path, '(^|/)(target|node_modules|vendor|dist|build|__pycache__)/') THEN 'service' WHEN regexp_matches(path, '(^|/)\\.[^/]+') AND NOT regexp_matches(path, '(^|/)\\.well-known') THEN 'hidden' END AS why FROM walked)
SELECT count(*) AS files, count(*) FILTER (WHERE why = 'hidden') AS hidden, count(*) FILTER (WHERE why = 'service') AS service, count(*) FILTER (WHERE why IS NULL AND bytes > 1000000) AS oversized FROM w""")
def walk_counters(spark, sf_dir):
    return src.walk_counts(fixture(spark, "walked"))


@example(f"""WITH {sql('blocks_then', 'blocks_now')} SELECT n.name, CASE WHEN t.body IS NULL THEN 'doc-missing' ELSE 'doc-drift' END AS rule FROM blocks_now n LEFT JOIN blocks_then t ON n.name = t.name WHERE t.body IS NULL OR trim(t.body) <> trim(n.body)""")
def doc_drift(spark, sf_dir):
    return project.drift(fixture(spark, "blocks_then"), fixture(spark, "blocks_now"))


@example("SELECT * FROM (VALUES ('verify/test', 'ran', true), ('verify/lint', 'failed', false), ('verify/coverage', 'ran', false)) AS t(id, state, proven)")
def tool_outcomes(spark, sf_dir):
    o = fixture(spark, "outcomes")
    return o.select("id", gate.outcome(F.col("state"), F.col("text")).alias("state"), gate.proves_tests(F.col("text")).alias("proven"))


@example(f"""WITH {sql('found')}, b AS (SELECT *, CASE WHEN NOT verified THEN 'dropped' WHEN severity >= 3 THEN 'blocking' WHEN rule IN ('debt-marker', 'ssn-us') THEN 'advisory' ELSE 'warning' END AS bucket FROM found)
SELECT rule, cap, bucket FROM b""")
def buckets(spark, sf_dir):
    return derived.escalated(gate.bucketed(fixture(spark, "found"))).select("rule", "cap", "bucket")


@example(f"""WITH {sql('found')} SELECT cap, count(*) AS findings, 'ran' AS state FROM found GROUP BY cap""")
def scan_summary(spark, sf_dir):
    found = fixture(spark, "found")
    return scan.summary(found, fixture(spark, "shop"), [r[0] for r in found.select("cap").distinct().collect()])


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    return session_counts(read(spark, sf_dir, "events"))


# Every rule finds the text that is made for it


def _own_texts(rules: list[R.Rule]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(f"{i}/{POSITIVE[r.id][0]}", POSITIVE[r.id][1], r.id) for i, r in enumerate(rules)]
        made = spark.createDataFrame(rows, "path string, content string, own string")
        files = made.select("path", extension(F.col("path")).alias("ext"), "content")
        found = scan.scan(files, src.lines(files), rules).select("path", "rule").distinct()
        return found.join(made.select("path", F.col("own").alias("rule")), ["path", "rule"], "left_semi").select("rule")

    return run


for _name, _rules, _ids in (
    ("rules_secret", R.SECRET, "aws-access-key github-token stripe-key google-api-key jwt gitlab-token slack-token sendgrid-key npm-token twilio-sid twilio-auth-token azure-account-key aws-secret-key llm-api-key digitalocean-token mailgun-key mapbox-secret-token sentry-dsn firebase-fcm-key db-uri-password private-key gcp-private-key generic-secret generic-secret-long generic-passphrase generic-secret-unquoted generic-secret-plist generic-secret-xml"),
    ("rules_owasp", R.OWASP, "permissive-authz cors-wildcard cors-reflect-origin idor-direct-ref weak-hash weak-cipher ecb-mode hardcoded-crypto-material insecure-random tls-verify-off sql-injection dangerous-exec xss-sink ssti debug-enabled jwt-none jwt-alg-confusion weak-pw-hash insecure-deser pii-in-log ssrf ssrf-internal-host"),
    ("rules_pii", R.PII, "ssn-us credit-card pii-in-log email-literal"), ("rules_smell", R.SMELL, "swallowed-error panic-path debt-marker"),
    ("rules_web", R.WEB_RULES, "ssrf-sink ssrf-internal-host open-redirect path-traversal ssti xxe xxe-parser-default insecure-deserialize unsafe-yaml-load command-exec-runtime tls-verify-disabled cors-wildcard cors-reflect-origin insecure-cookie csrf-disabled"),
    ("rules_api", R.API, "jwt-none-alg jwt-alg-confusion graphql-introspection mass-assignment"),
    ("rules_injection", R.INJECTION, "raw-innerhtml raw-outerhtml insert-adjacent-html react-raw-html angular-bypass-sanitizer vue-raw-html document-write html-string-concat template-literal-html sql-string-concat"),
    ("rules_iac", R.IAC, "privileged-container host-network host-pid allow-priv-escalation cap-add-all run-as-root image-latest-tag from-latest-tag add-remote-url dockerfile-curl-bash"),
    ("rules_ai", R.AI, "llm-prompt-untrusted-concat llm-prompt-build-untrusted llm-output-exec llm-output-raw-html"), ("rules_completeness", R.COMPLETENESS, "unimplemented-stub empty-catch swallowed-rescue empty-except empty-function"),
    ("rules_compliance", R.COMPLIANCE, "pdn-in-logs pdn-in-logs-multiline foreign-db-host foreign-region foreign-tracker pre-checked-consent foreign-crypto-primitive"),
    ("rules_mobile", R.MOBILE, "mobile-exported-no-permission mobile-cleartext-traffic mobile-cleartext-permitted mobile-debuggable mobile-allow-backup mobile-ats-arbitrary-loads mobile-ats-arbitrary-media mobile-ats-insecure-http mobile-assetlinks-wildcard-fingerprint mobile-aasa-wildcard-paths mobile-firebase-cloud-messaging-key mobile-mapbox-secret-token mobile-token-in-sharedprefs mobile-token-in-userdefaults"),
    ("rules_desktop", R.DESKTOP, "desktop/electron-node-integration desktop/electron-context-isolation-off desktop/electron-remote-module desktop/electron-websecurity-off desktop/electron-insecure-content desktop/electron-sandbox-off desktop/electron-loadurl-cleartext desktop/tauri-allowlist-all desktop/tauri-shell-execute desktop/tauri-csp-null desktop/tauri-remote-ipc desktop/tauri-updater-cleartext desktop/tauri-updater-no-pubkey"),
):
    EXAMPLES[_name] = _own_texts(_rules)
    EXAMPLE_SQL[_name] = f"SELECT unnest(string_split('{_ids}', ' ')) AS rule"


# The star schema


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_equi(spark, sf_dir):
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY o_orderpriority""")
def join_range(spark, sf_dir):
    l, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    near = (l.l_orderkey == o.o_orderkey) & (l.l_shipdate > o.o_orderdate) & (l.l_shipdate <= o.o_orderdate + F.expr("INTERVAL 30 DAYS"))
    return l.join(o, near).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment")
def join_semi(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment")
def join_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_keys(spark, sf_dir):
    big = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).subtract(big)


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
def distinct_sets(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_tax), 6) AS avg_tax, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling FROM orders")
def sliding_sum(spark, sf_dir):
    frame = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(frame), 2).alias("rolling"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS best_order, max(o_totalprice) AS best FROM orders GROUP BY o_custkey")
def argmax_order(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best_order"), F.max("o_totalprice").alias("best"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k, o_orderpriority FROM orders)
SELECT o_orderpriority, k, o_orderkey FROM t WHERE k <= 3""")
def topk_per_group(spark, sf_dir):
    frame = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("k", F.row_number().over(frame)).where("k <= 3").select("o_orderpriority", "k", "o_orderkey")


@query("SELECT s_nationkey AS key FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def intersect_keys(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")).intersect(read(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_nationkey"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def union_counts(spark, sf_dir):
    out = None
    for t in ("documents", "pages", "events"):
        one = read(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# Project data


@example("""SELECT * FROM (VALUES ('security.scan', 'core', 10), ('security.scan', 'enterprise', 2), ('security.ai', 'core', 3), ('quality.check', 'core', 9), ('quality.ui', 'core', 6), ('code.intel', 'core', 9), ('verify', 'core', 7), ('generate', 'core', 11),
  ('deliver', 'core', 2), ('setup', 'core', 2), ('spec.check', 'core', 1), ('spec', 'core', 1), ('compliance.ru', 'core', 5), ('compliance.ru', 'enterprise', 1), ('memory', 'core', 3), ('backlog', 'core', 2)) AS t(family, tier, n)""")
def capability_counts(spark, sf_dir):
    return registry(spark).groupBy("family", "tier").agg(F.count("*").alias("n"))


@example("""SELECT id, CAST(score AS DOUBLE) AS score FROM (VALUES ('security.scan/secret', 0.4), ('compliance.ru/pdn-logs', 0.3), ('compliance.ru/pdn-logs-ast', 0.3), ('security.scan/pii', 0.3), ('code.intel/call_graph', 0.1), ('code.intel/find_usages', 0.1)) AS t(id, score)""")
def router_topk(spark, sf_dir):
    return rank.router(registry(spark), "find leaked secrets and personal data in logs").withColumn("score", F.round("score", 6))


@query("""WITH g AS (SELECT doc_id, label FROM (SELECT d.doc_id, CASE WHEN regexp_matches(d.text, '@example\\.com') THEN 'mail' WHEN regexp_matches(d.text, '[0-9]{16}') THEN 'card' ELSE 'none' END AS label FROM documents d))
SELECT lang, label, count(*) AS n FROM g JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, label), (lang), ())""")
def grouping_sets(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("label", F.when(F.col("text").rlike(r"@example\.com"), "mail").when(F.col("text").rlike("[0-9]{16}"), "card").otherwise("none"))
    return d.groupingSets([["lang", "label"], ["lang"], []], "lang", "label").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, e.user_id, coalesce((SELECT max(b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'purchase' AND b.ts < e.ts
   AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'purchase' AND c.ts < e.ts)), -1) AS last_purchase
FROM events e WHERE e.event_type = 'error'""")
def asof_purchase(spark, sf_dir):
    """The last purchase before each error of a user: one pass over the user's events, no join."""
    frame = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    e = read(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return e.withColumn("p", F.max(bought).over(frame)).where("event_type = 'error'").select("event_id", "user_id", F.coalesce("p.event_id", F.lit(-1)).alias("last_purchase"))


@query("""SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c
FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON c.c_nationkey = s.s_nationkey""")
def join_outer(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, -1) AS next_order, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank, percent_rank() OVER w AS share FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_ranks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lead("o_orderkey").over(w), F.lit(-1)).alias("next_order"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(p).alias("priority_rank"), F.percent_rank().over(w).alias("share"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(stddev_samp(l_extendedprice), 4) AS deviation FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    p = rank.percentiles(l, ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p90": 0.9}).alias("p")
    d = l.groupBy("l_returnflag").agg(F.stddev_samp("l_extendedprice").alias("deviation")).alias("d")
    return d.join(p, F.col("d.l_returnflag").eqNullSafe(F.col("p.l_returnflag")), "left").select("d.l_returnflag", *[F.round(c, 4).alias(c) for c in ("median", "p90", "deviation")])


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot(spark, sf_dir):
    out = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.select("priority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("SELECT symbol, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))) AS symbol FROM documents) GROUP BY 1")
def symbol_spread(spark, sf_dir):
    """In how many documents each sign stands."""
    d = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[#*$%&|<>]"), F.lit(0)))).alias("symbol"))
    return d.groupBy("symbol").agg(F.count("*").alias("n"))

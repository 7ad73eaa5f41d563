"""Queries over the given tables that need more than one pass or a stream: path tries, interval joins, state, changes,
sketches, nested values, table functions. Each has SQL that computes its answer by a plainer way."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import masking
from tessera.functions import tables as functions
from tessera.operators import changes, graph, intervals, nested, rank, sketches, trie
from tessera.plans import oracle
from tessera.plans.queries import doc_findings, query, read
from tessera.sources import committed
from tessera.streaming import state

# Paths: links and addresses of pages against the folders of the pages

_WHERE = r"^[A-Za-z]+://([^/?#]+)([^?#]*)"


def page_modules(pages: DataFrame) -> DataFrame:
    """(page_id, module): the folder of a page under the labels of its host."""
    host, path = (F.regexp_extract("url", _WHERE, i) for i in (1, 2))
    folders = F.filter(F.split(path, "/"), lambda s: s != "")
    return pages.select("page_id", F.array_join(F.concat(F.split(host, r"\."), F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))), "/").alias("module"))


def link_targets(pages: DataFrame) -> DataFrame:
    """(page_id, target): what the links of a page name."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""href=["']([^"'#]+)["']"""), F.lit(1)))).alias("target"))


def known_modules(pages: DataFrame) -> DataFrame:
    """(module): the folders with their hosts, and their last names by themselves, as a link within a site has them."""
    own = page_modules(pages).select("module")
    return own.unionByName(own.select(F.element_at(F.split("module", "/"), -1).alias("module"))).distinct()


_PATHS = r"""WITH w AS (SELECT page_id, url, html, string_split(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)([^?#]*)', 1), '.') AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)([^?#]*)', 2), '/'), lambda s: s <> '') AS folders FROM pages),
own AS (SELECT page_id, array_to_string(list_concat(host, folders[1:greatest(len(folders) - 1, 0)]), '/') AS module FROM w),
known AS (SELECT module FROM own UNION SELECT list_last(string_split(module, '/')) FROM own),
links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"''#]+)["'']', 1)) AS target FROM pages),
targets AS (SELECT target FROM links UNION SELECT url FROM pages),
parts AS (SELECT target, list_filter(list_transform(regexp_split_to_array(target, '[/.:\\ {};"''<>]'), lambda s: trim(s)), lambda s: s <> '') AS p FROM targets),
runs AS (SELECT target, i, j, array_to_string(p[i:j], '/') AS run, p FROM parts, unnest(range(1, len(p) + 1)) a(i), unnest(range(1, len(p) + 1)) b(j) WHERE i <= j),
met AS (SELECT target, arg_max(run, (j - i) * 1000 - i) AS module FROM runs JOIN known ON run = module GROUP BY target),
lasts AS (SELECT list_last(string_split(module, '/')) AS last, min(module) AS module FROM known GROUP BY 1 HAVING count(*) = 1),
resolved AS (SELECT target, module FROM met
  UNION ALL SELECT target, module FROM parts JOIN lasts ON p[1] = last WHERE len(p) = 1 AND target NOT IN (SELECT target FROM met))
"""


@query(_PATHS + "SELECT target, module FROM resolved")
def link_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and links by the folder that their longest run of segments names."""
    pages = read(spark, sf_dir, "pages")
    targets = link_targets(pages).select("target").unionByName(pages.select(F.col("url").alias("target")))
    return trie.resolve(targets, known_modules(pages))


@query(_PATHS + "SELECT own.module AS src, resolved.module AS dst, count(*) AS n FROM own JOIN links USING (page_id) JOIN resolved USING (target) WHERE own.module <> resolved.module GROUP BY 1, 2")
def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and the folders that their pages link to."""
    pages = read(spark, sf_dir, "pages")
    links = graph.cut(link_targets(pages))
    found = trie.resolve(links, known_modules(pages))
    named = links.join(page_modules(pages), "page_id").join(found.select("target", F.col("module").alias("dst")), "target")
    return named.where("module <> dst").groupBy(F.col("module").alias("src"), "dst").agg(F.count("*").alias("n"))


# Intervals


@query("""WITH spans AS (SELECT epoch_us(o_orderdate) // 1000000 AS s, epoch_us(l_shipdate) // 1000000 AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
peaks AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, epoch_us(min(o_orderdate)) // 1000000 AS s, epoch_us(min(o_orderdate)) // 1000000 + 86400 * (1 + count(*) % 20) AS e FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, strftime(month, '%Y-%m') AS month, count(*) AS n, CAST(sum(least(spans.e, peaks.e) - greatest(spans.s, peaks.s)) AS BIGINT) AS seconds
FROM peaks JOIN spans ON spans.s <= peaks.e AND peaks.s <= spans.e WHERE spans.s <= spans.e GROUP BY 1, 2""")
def shipping_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods on their way (order to shipment) during windows at the start of each month and priority: an interval join. Goods that
    are on their way in the same seconds are joined as one, with their number."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    spans = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(second("o_orderdate").alias("s"), second("l_shipdate").alias("e")).agg(F.count("*").alias("n"))
    first = F.min(second("o_orderdate"))
    peaks = orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(first.alias("s"), (first + 86400 * (1 + F.count("*") % 20)).alias("e"))
    seconds = F.least("l.e", "r.e") - F.greatest("l.s", "r.s")
    met = intervals.overlaps(graph.cut(spans), graph.cut(peaks), ("s", "e"), ("s", "e"))
    return met.groupBy("r.o_orderpriority", "r.month").agg(F.sum("l.n").alias("n"), F.sum(F.col("l.n") * seconds).alias("seconds"))


# Streams: the events as they might arrive


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e),
g AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM s GROUP BY user_id, session)
SELECT user_id, started, ended, n, errors, CASE WHEN 2 * errors >= n THEN 'failing' WHEN errors > 0 THEN 'watch' ELSE 'clean' END AS verdict FROM g""")
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a verdict, by keyed state over a stream of three late, shuffled portions, restarted between them."""
    return state.replayed(state.in_portions(read(spark, sf_dir, "events")), state.session_verdicts, graph.shared_folder(spark))


@query("""WITH p AS (SELECT event_id AS first_id, user_id, ts FROM events WHERE event_type = 'purchase'), x AS (SELECT event_id AS then_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT p.first_id, p.user_id, p.ts AS first_ts, coalesce(x.then_id, -1) AS then_id, x.ts AS then_ts FROM p LEFT JOIN x ON x.user_id = p.user_id AND x.ts >= p.ts AND x.ts <= p.ts + INTERVAL 10 MINUTE""")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within ten minutes of a purchase, by a join of two streams; purchases without one come once the watermark has passed."""
    work = lambda s: state.followed(s.where("event_type = 'purchase'"), s.where("event_type = 'error'"))
    return state.replayed(state.in_portions(read(spark, sf_dir, "events")), work, graph.shared_folder(spark)).where("user_id <> -1").fillna(-1, ["then_id"])


# Sinks with a commit


@query(oracle.FINDINGS + """SELECT rule, list_extract(['note', 'note', 'warning', 'error', 'error'], severity + 1) AS level, list_extract([10, 25, 55, 85, 100], severity + 1) AS rank, path, line_no FROM found""")
def sarif_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the documents as one SARIF file, written by all tasks and read back."""
    path = f"{graph.shared_folder(spark)}/report-{uuid.uuid4().hex}/findings.sarif"
    committed.write_sarif(doc_findings(spark, sf_dir), path)
    return committed.results_of(spark, path)


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'en') GROUP BY lang UNION ALL SELECT 'ids', CASE WHEN count(*) = 0 THEN 0 ELSE count(*) END FROM documents WHERE lang IN ('de', 'en')")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from two writers at a time: by language, and how many of the ids from 0 up to the greatest are taken once."""
    folder = f"{graph.shared_folder(spark)}/records-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    committed.register(spark)

    def write(lang: str) -> None:
        committed.append_records(docs.where(F.col("lang") == lang).select(F.to_json(F.struct("doc_id", "lang"))), folder)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, ("de", "en")))
    found = graph.cut(committed.read_records(spark, folder))
    by = found.groupBy(F.get_json_object("body", "$.lang").alias("lang")).agg(F.count("*").alias("n"))
    whole = found.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").agg(F.when(F.max("id") + 1 == F.count("*"), F.count("*")).otherwise(-1).alias("n"))
    return by.unionByName(whole.select(F.lit("ids").alias("lang"), "n"))


# Changes


@query("""WITH later AS (SELECT CASE WHEN doc_id BETWEEN 60 AND 90 AND doc_id % 5 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id,
  CASE WHEN doc_id BETWEEN 60 AND 90 AND doc_id % 7 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id = 20 THEN 'xx' ELSE lang END AS lang FROM documents)
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents d FULL JOIN later l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.text IS DISTINCT FROM l.text OR d.lang IS DISTINCT FROM l.lang""")
def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an altered copy, by hash trees of both."""
    docs, folder = read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), f"{graph.shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    here = F.col("doc_id").between(60, 90)
    later = docs.select(F.when(here & (F.col("doc_id") % 5 == 0), F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(here & (F.col("doc_id") % 7 == 0), None).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") == 20, "xx").otherwise(F.col("lang")).alias("lang"))
    before = changes.take(docs, "doc_id", f"{folder}/before")
    after = changes.take(later, "doc_id", f"{folder}/after", before.ranges)
    return changes.compare(spark, before, after).select(F.col("key").alias("doc_id"), "change")


# Sketches, nested values, table functions


@query("""SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, true AS distinct_held, true AS median_held, list_slice(list(l_linenumber ORDER BY c DESC, l_linenumber), 1, 1)[1] AS most
FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, strftime(l_shipdate, '%Y-%m'), l_linenumber) AS c FROM lineitem) GROUP BY 1, 2""")
def item_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by flag and day, merged to months: whether their bounds hold the exact distinct parts and median price, and the most
    frequent line number."""
    items = read(spark, sf_dir, "lineitem").withColumns({"month": F.date_format("l_shipdate", "yyyy-MM"), "day": F.to_date("l_shipdate")})
    by = ["l_returnflag", "month"]
    stored = graph.cut(sketches.parts(items, [*by, "day"], "l_partkey", "l_extendedprice", "l_linenumber"))
    told = sketches.estimates(sketches.merged(stored, by), by, k=7)
    exact = items.groupBy(*by).agg(F.countDistinct("l_partkey").alias("d"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("m"))
    top = F.array_sort("frequent", lambda a, b: F.when(a["count"] != b["count"], (b["count"] - a["count"]).cast("int")).otherwise(a["item"] - b["item"]))
    same = F.col("t.l_returnflag").eqNullSafe(F.col("e.l_returnflag")) & F.col("t.month").eqNullSafe(F.col("e.month"))
    return told.alias("t").join(exact.alias("e"), same).select(*[f"t.{c}" for c in by], "n", F.col("d").between(F.col("distinct_low"), F.col("distinct_high")).alias("distinct_held"), F.col("m").between(F.col("quantile_low"), F.col("quantile_high")).alias("median_held"), top[0]["item"].alias("most"))


_EVENT_JSON = """'{"type": "' || event_type || '", "at": [' || user_id || ', "x", ' || props || '], "props": ' || props || ', "none": null, "half": 0.5}'"""


@query(rf"""WITH t AS (SELECT {_EVENT_JSON} AS j FROM events), w AS (SELECT unnest([j]) AS j FROM t), n AS (SELECT e.fullkey AS path, e.type AS kind FROM t, json_tree(t.j) e)
SELECT regexp_replace(replace(path, '"', ''), '\[\d+\]', '[*]', 'g') AS path, CASE kind WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL(1,1)' WHEN 'NULL' THEN 'VOID' ELSE kind END AS type, count(*) AS n FROM n GROUP BY 1, 2""")
def event_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, types and counts of nested documents made of the events, by variants and a recursive query."""
    return nested.shapes(read(spark, sf_dir, "events").select("event_id", F.expr(_EVENT_JSON).alias("j")), "event_id", "j")


@query("""WITH l AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents)
SELECT lang, doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract(line, '[0-9]{16}') AS found, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS hit FROM l WHERE regexp_matches(line, '[0-9]{16}')""")
def lines_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-like numbers by a table function that SQL calls, counted within each language. The function sees the documents where
    they lie; only its hits are ordered."""
    functions.register(spark)
    found = spark.sql("SELECT lang, doc_id, line_no, found FROM find_lines(TABLE(SELECT lang, doc_id, text FROM {docs}), text => 'text', pattern => '[0-9]{{16}}')", docs=read(spark, sf_dir, "documents"))
    return rank.running(graph.cut(found), ["lang"], [F.asc_nulls_last("doc_id"), F.asc("line_no")]).withColumn("hit", F.col("before") + 1).drop("before")


# Masking


def _mask_sql() -> str:
    """The states by name, a mark at a time: a recursive walk over the marks of each page, with the moves as a list."""
    mark = r"""'(?i)<!--|-->|<script\b|<style\b|</script\s*>|</style\s*>|<[a-z/!]|>|"|'''"""
    name = r"CASE WHEN regexp_matches(m, '(?i)^<[a-z/!]$') THEN '<' ELSE regexp_replace(lower(m), '\s+', '', 'g') END"
    space = r"regexp_replace({}, '[^\r\n]', ' ', 'g')"
    moves = [("<!--", "text", "comment"), ("-->", "comment", "text"), ("<script", "text", "script tag"), ("<style", "text", "style tag"), ("</script>", "script", "text"), ("</style>", "style", "text"), ("<", "text", "tag")]
    for tag, then in (("tag", "text"), ("script tag", "script"), ("style tag", "style")):
        moves += [(">", tag, then), ("-->", tag, then)]
        for quote in ('"', "'"):
            moves += [(quote, tag, tag + quote), (quote, tag + quote, tag)]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join("(" + ", ".join(map(quoted, m)) + ")" for m in moves)
    shut = "(" + ", ".join(map(quoted, ["comment", "script", "style", *[t + q for t in ("tag", "script tag", "style tag") for q in ('"', "'")]])) + ")"
    return f"""WITH RECURSIVE moves AS (SELECT map_from_entries(list(struct_pack(k := mark || chr(1) || before, v := after))) AS f FROM (VALUES {listed}) v(mark, before, after)),
p AS (SELECT page_id, regexp_extract_all(html, {mark}) AS marks, regexp_split_to_array(html, {mark}) AS pieces FROM pages),
s AS (SELECT page_id, marks, pieces, 0 AS i, 'text' AS state, pieces[1] AS out FROM p
  UNION ALL SELECT page_id, marks, pieces, i + 1, to_state, out || CASE WHEN state IN {shut} AND to_state = state THEN {space.format('m')} ELSE m END || CASE WHEN to_state IN {shut} THEN {space.format('piece')} ELSE piece END
  FROM (SELECT *, coalesce(f[{name} || chr(1) || state], state) AS to_state FROM (SELECT *, marks[i + 1] AS m, pieces[i + 2] AS piece FROM s, moves WHERE i < len(marks))))
SELECT page_id, true AS same_length, sha256(out) AS digest FROM s WHERE i = len(marks)"""


@query(_mask_sql())
def masked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with comments, scripts, styles and attribute values blanked: whether the length stays, and the digest."""
    masked = masking.masked_markup(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", "html", masked.alias("masked")).select("page_id", (F.length("masked") == F.length("html")).alias("same_length"), F.sha2("masked", 256).alias("digest"))


# Graphs: users and the users whose purchases come next


_HANDED = """WITH RECURSIVE big AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND value > 60),
n AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM big), e AS (SELECT DISTINCT src, dst FROM n WHERE src <> dst),
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
"""


def handed_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): users and who makes the next large purchase. The order over all is taken by hours first, so no task sorts all."""
    big = read(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 60").withColumn("slot", F.date_trunc("day", "ts"))
    within = Window.partitionBy("slot").orderBy("ts", "event_id")
    inner = big.select("slot", F.col("user_id").alias("src"), F.lead("user_id").over(within).alias("dst"))
    ends = big.groupBy("slot").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.orderBy("slot")).alias("dst"))  # a row for each day
    return inner.select("src", "dst").unionByName(across).where("dst IS NOT NULL AND src <> dst").distinct()


@query(_HANDED + "SELECT CAST(a.src AS BIGINT) AS node, min(least(a.src, b.src)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def purchase_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the users that purchases lead through, named by their smallest user."""
    return graph.cycles(graph.cut(handed_on(spark, sf_dir))).select("node", "component")


@query(_HANDED + "SELECT dst AS node FROM reach WHERE src = (SELECT min(src) FROM e) UNION SELECT min(src) FROM e")
def purchase_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that purchases lead to from the smallest user on: a breadth-first closure."""
    edges = graph.cut(handed_on(spark, sf_dir))
    return graph.closure_from(edges.agg(F.min("src").alias("node")), edges)

"""Catalogue, part 1: novelty, dedupe, caps, folds, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, folds, relops, render, stats
from .catalogue import register
from .tables import PAGE, POSTS_SQL, SEEN_SQL, posts, read, seen

L = "BIGINT"

# --- novelty and scans -------------------------------------------------------

SCAN_SQL = """
marked AS (
    SELECT p.*, EXISTS (SELECT 1 FROM seen s WHERE s.source_key = p.source_key AND s.doc_id = p.doc_id) AS is_seen
    FROM posts p WHERE page <= {most}
), per_page AS (
    SELECT source_key, page, bool_and(is_seen) AS all_seen FROM marked GROUP BY 1, 2
), stops AS (
    SELECT source_key, least(min(CASE WHEN all_seen THEN page END), CASE WHEN max(page) < {most} THEN max(page) + 1 END) AS stop
    FROM per_page GROUP BY 1
), met AS (
    SELECT m.*, stop FROM marked m JOIN stops USING (source_key) WHERE page <= coalesce(stop, {most})
)"""


def _scan(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    return relops.boundary_scan(posts(spark, sf_dir).select("source_key", "doc_id", "page"), seen(spark, sf_dir), "source_key", "doc_id", "page", most)


@register(
    "new_item_digest",
    f"""WITH {POSTS_SQL}, {SEEN_SQL}, {SCAN_SQL.format(most=10)},
    fresh AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY doc_id DESC) AS rn FROM met WHERE NOT is_seen)
    SELECT source_key, count(*)::{L} AS n_new,
           max(CASE WHEN rn = 1 THEN CASE WHEN length(s) > 60 THEN substr(s, 1, 60) || ' …' ELSE s END END) AS top_title
    FROM (SELECT *, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS s FROM fresh WHERE rn <= 50) GROUP BY 1""",
)
def new_item_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen-filter, boundary scan, flood cap, excerpt and count for each source."""
    new = _scan(spark, sf_dir, 10).where("is_new").select("source_key", "doc_id")
    kept = relops.newest(new, ["source_key"], [F.desc("doc_id")], 50)
    per = kept.groupBy("source_key").agg(F.count("*").alias("n_new"), F.max("doc_id").alias("doc_id"))
    titles = read(spark, sf_dir, "documents", "doc_id", "text")
    return per.join(titles, "doc_id").select("source_key", "n_new", T.truncate(T.squish("text"), 60).alias("top_title"))


@register("new_items_anti_join", f"WITH {SEEN_SQL} SELECT source AS source_key, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_key = d.source AND s.doc_id = d.doc_id)")
def new_items_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.new_items(posts(spark, sf_dir), seen(spark, sf_dir), ["source_key", "doc_id"]).select("source_key", "doc_id")


@register("seen_flag_join", f"WITH {SEEN_SQL} SELECT source AS source_key, d.doc_id, s.doc_id IS NOT NULL AS seen FROM documents d LEFT JOIN seen s ON s.source_key = d.source AND s.doc_id = d.doc_id")
def seen_flag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.flag_seen(posts(spark, sf_dir), seen(spark, sf_dir), ["source_key", "doc_id"]).select("source_key", "doc_id", "seen")


for _name, _most in (("boundary_scan", 10), ("boundary_scan_backlog", 1)):

    @register(_name, f"WITH {POSTS_SQL}, {SEEN_SQL}, {SCAN_SQL.format(most=_most)} SELECT source_key, doc_id, page::{L} AS page, NOT is_seen AS is_new, stop IS NOT NULL AS reached, count(*) OVER (PARTITION BY source_key)::{L} AS scanned FROM met")
    def _boundary(spark: SparkSession, sf_dir: str, most: int = _most) -> DataFrame:
        return _scan(spark, sf_dir, most).withColumn("page", F.col("page").cast("long"))


@register(
    "boundary_scan_pinned",
    f"""WITH {POSTS_SQL}, pin AS (SELECT source_key, max(doc_id) AS doc_id FROM posts GROUP BY 1),
    seen AS (SELECT * FROM pin UNION SELECT source AS source_key, doc_id FROM documents WHERE doc_id % 7 = 0),
    every AS (SELECT source_key, doc_id, page FROM posts UNION SELECT source_key, pin.doc_id, page FROM pin JOIN (SELECT DISTINCT source_key, page FROM posts) USING (source_key)),
    marked AS (SELECT e.*, min(page) OVER (PARTITION BY source_key, doc_id) AS first_page, EXISTS (SELECT 1 FROM seen s WHERE s.source_key = e.source_key AND s.doc_id = e.doc_id) AS is_seen FROM every e WHERE page <= 3),
    per_page AS (SELECT source_key, page, bool_and(is_seen) AS all_seen, count(*) FILTER (WHERE first_page = page) AS fresh FROM marked GROUP BY 1, 2),
    stops AS (SELECT source_key, least(min(CASE WHEN all_seen OR fresh = 0 THEN page END), CASE WHEN max(page) < 3 THEN max(page) + 1 END) AS stop FROM per_page GROUP BY 1)
    SELECT source_key, doc_id, page::{L} AS page, NOT is_seen AS is_new, stop IS NOT NULL AS reached, count(*) OVER (PARTITION BY source_key)::{L} AS scanned
    FROM marked JOIN stops USING (source_key) WHERE page = first_page AND page <= coalesce(stop, 3)""",
)
def boundary_scan_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned, seen post heads every page and must not stop the scan."""
    p = posts(spark, sf_dir).select("source_key", "doc_id", "page")
    pin = p.groupBy("source_key").agg(F.max("doc_id").alias("doc_id"))
    every = p.unionByName(pin.join(p.select("source_key", "page").distinct(), "source_key")).distinct()
    known = pin.unionByName(p.where("doc_id % 7 = 0").select("source_key", "doc_id")).distinct()
    return relops.boundary_scan(every, known, "source_key", "doc_id", "page", 3).withColumn("page", F.col("page").cast("long"))


@register(
    "baseline_gate",
    f"""WITH {POSTS_SQL}, s AS (SELECT source_key, regexp_extract(source_key, '[0-9]+')::INT % 3 <> 0 AS baselined, count(*)::{L} AS scanned FROM posts GROUP BY 1)
    SELECT source_key, baselined, scanned, CASE WHEN baselined THEN scanned ELSE 0 END::{L} AS emitted, scanned > 0 AS baselined_after FROM s""",
)
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's first run only records; one without rows never becomes baselined."""
    s = posts(spark, sf_dir).groupBy("source_key").agg(F.count("*").alias("scanned"))
    s = s.withColumn("baselined", F.regexp_extract("source_key", "[0-9]+", 0).cast("int") % 3 != 0)
    return s.select("source_key", "baselined", "scanned", F.when(F.col("baselined"), F.col("scanned")).otherwise(F.lit(0)).cast("long").alias("emitted"), (F.col("scanned") > 0).alias("baselined_after"))


@register("all_sources_failed", f"SELECT count(*)::{L} AS selected, count_if(n > 0)::{L} AS succeeded, count(*) > 0 AND count_if(n > 0) = 0 AS all_failed FROM (SELECT s_suppkey, count(doc_id) AS n FROM supplier LEFT JOIN documents ON source = 'src' || s_suppkey GROUP BY 1)")
def all_sources_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without rows hasn't succeeded; the run fails if none has."""
    n = read(spark, sf_dir, "documents", "source").groupBy("source").agg(F.count("*").alias("n"))
    s = read(spark, sf_dir, "supplier", "s_suppkey").withColumn("source", F.concat(F.lit("src"), F.col("s_suppkey").cast("string"))).join(n, "source", "left")
    good = F.count_if(F.coalesce("n", F.lit(0)) > 0)
    return s.agg(F.count("*").alias("selected"), good.alias("succeeded"), ((F.count("*") > 0) & (good == 0)).alias("all_failed"))


# --- dedupe and caps ---------------------------------------------------------


@register("first_wins_dedupe", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.first_wins(read(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("drop_all_duplicates", "SELECT conv_id, turn, role FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations WHERE conv_id IS NOT NULL) WHERE n = 1 AND length(text) >= 20")
def drop_all_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    return relops.drop_all_duplicates(df, ["conv_id", "role"], F.length("text") >= 20).select("conv_id", "turn", "role")


@register(
    "seen_union_cap",
    f"""WITH n AS (SELECT event_type, user_id, min(event_id) AS o FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), x AS (SELECT event_type, user_id, min(event_id) AS o FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2),
    u AS (SELECT event_type, user_id, 0 AS side, o FROM n UNION ALL SELECT event_type, user_id, 1, o FROM x),
    d AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY side, o) AS k FROM u)
    SELECT event_type, user_id, ord FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY side, o, user_id)::{L} AS ord FROM d WHERE k = 1) WHERE ord <= 40""",
)
def seen_union_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_type", "user_id", "event_id")
    return relops.union_cap(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_type", "user_id", "event_id", 40).withColumn("ord", F.col("ord").cast("long"))


@register("flood_cap", f"SELECT source AS source_key, doc_id, rn <= 5 AS sent FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents WHERE doc_id % 5 >= 3)")
def flood_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each source are sent; all of them become seen."""
    new = relops.new_items(posts(spark, sf_dir).select("source_key", "doc_id"), seen(spark, sf_dir), ["source_key", "doc_id"])
    rn = F.row_number().over(W.partitionBy("source_key").orderBy(F.desc("doc_id")))
    return new.select("source_key", "doc_id", (rn <= 5).alias("sent"))


@register("fair_cap_round_robin", f"SELECT source_key, doc_id, turn::{L} AS turn FROM (SELECT source AS source_key, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS turn FROM documents WHERE n_chars >= 200) ORDER BY turn, source_key LIMIT 40")
def fair_cap_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "source", "doc_id", "n_chars").where("n_chars >= 200").select(F.col("source").alias("source_key"), "doc_id")
    return relops.round_robin(df, "source_key", "source_key", [F.desc("doc_id")], 40).select("source_key", "doc_id", F.col("turn").cast("long").alias("turn"))


@register("page_limit", f"WITH {POSTS_SQL} SELECT source_key, page::{L} AS page, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source_key, page ORDER BY pos) AS k FROM posts) WHERE k <= 4")
def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.newest(posts(spark, sf_dir), ["source_key", "page"], ["pos"], 4).select("source_key", F.col("page").cast("long").alias("page"), "doc_id")


@register("per_source_sample", "SELECT source AS source_key, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= greatest(1, 2)")
def per_source_sample(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    return relops.newest(posts(spark, sf_dir), ["source_key"], ["doc_id"], max(1, k)).select("source_key", "doc_id")


# --- folds -------------------------------------------------------------------


@register(
    "greedy_batches",
    """WITH r AS (SELECT source AS source_key, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    walk AS (
        WITH RECURSIVE w AS (
            SELECT source_key, doc_id, k, 0::BIGINT AS batch, 1::BIGINT AS n, n_chars::BIGINT AS used FROM r WHERE k = 1
            UNION ALL
            SELECT r.source_key, r.doc_id, r.k,
                   CASE WHEN w.n >= 8 OR w.used + r.n_chars > 20000 THEN w.batch + 1 ELSE w.batch END,
                   CASE WHEN w.n >= 8 OR w.used + r.n_chars > 20000 THEN 1 ELSE w.n + 1 END,
                   CASE WHEN w.n >= 8 OR w.used + r.n_chars > 20000 THEN r.n_chars ELSE w.used + r.n_chars END
            FROM w JOIN r ON r.source_key = w.source_key AND r.k = w.k + 1
        ) SELECT * FROM w
    )
    SELECT source_key, doc_id, batch FROM walk""",
)
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "source", "doc_id", "n_chars").withColumnRenamed("source", "source_key")
    return folds.greedy_batches(df, "source_key", "doc_id", "n_chars", 8, 20000).withColumn("batch", F.col("batch").cast("long"))


@register(
    "attachment_budget_first_fit",
    """WITH r AS (SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    walk AS (
        WITH RECURSIVE w AS (
            SELECT order_key, line, size, k, size > 0 AND size <= 60 AS included, CASE WHEN size > 0 AND size <= 60 THEN 60 - size ELSE 60 END AS budget FROM r WHERE k = 1
            UNION ALL
            SELECT r.order_key, r.line, r.size, r.k, r.size > 0 AND r.size <= w.budget, CASE WHEN r.size > 0 AND r.size <= w.budget THEN w.budget - r.size ELSE w.budget END
            FROM w JOIN r ON r.order_key = w.order_key AND r.k = w.k + 1
        ) SELECT * FROM w
    ) SELECT order_key, line::BIGINT AS line, size, included FROM walk""",
)
def attachment_budget_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("size"))
    lines = lines.join(read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("order_key")), "order_key", "left_semi")
    return folds.first_fit(lines, "order_key", "line", "size", 60).withColumn("line", F.col("line").cast("long"))


BREAKER_SQL = """WITH a AS (SELECT user_id, event_id, (event_type = 'error')::INT AS f, sum(1 - (event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM a)
    SELECT user_id, event_id, coalesce(max((run >= 2)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted FROM b"""


@register("circuit_breaker_cut", BREAKER_SQL)
def circuit_breaker_cut(spark: SparkSession, sf_dir: str, limit: int = 2) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    return folds.circuit_breaker(e, "user_id", "event_id", F.col("event_type") == "error", limit).select("user_id", "event_id", "attempted")


@register("breaker_disabled", "SELECT user_id, event_id, true AS attempted FROM events")
def breaker_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circuit_breaker_cut(spark, sf_dir, 0)


@register(
    "time_budget_cut",
    "SELECT user_id, event_id, round(coalesce(sum(c) OVER w, 0), 4)::DOUBLE AS spent, 100 - coalesce(sum(c) OVER w, 0) > 2 AS started FROM (SELECT user_id, event_id, floor(abs(value)) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def time_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "value").withColumn("c", F.floor(F.abs("value")).cast("double"))
    return folds.budget_cut(e, "user_id", "event_id", "c", 100.0, 2.0).select("user_id", "event_id", F.round(F.col("spent").cast("double"), 4).alias("spent"), "started")


@register(
    "rpm_throttle_wait",
    "SELECT user_id, event_id, coalesce(greatest(0, 6.0 - (s - lag(s) OVER (PARTITION BY user_id ORDER BY event_id))), 0)::DOUBLE AS wait FROM (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)",
)
def rpm_throttle_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    return folds.throttle_wait(e, "user_id", "event_id", F.col("s"), 10).select("user_id", "event_id", "wait")


@register("backoff_schedule", f"SELECT event_id, (event_id % 6)::{L} AS attempt, CASE WHEN 1.5 * power(2, event_id % 6) < 20 THEN (1.5 * power(2, event_id % 6))::DOUBLE END AS wait FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id").withColumn("attempt", (F.col("event_id") % 6).cast("long"))
    return e.select("event_id", "attempt", folds.backoff(F.col("attempt"), 1.5, F.lit(20.0)).alias("wait"))


# --- statistics --------------------------------------------------------------

STATS_SQL = f"""s AS (
    SELECT CASE WHEN grouping(g) = 1 THEN '*' ELSE g END AS grp, count(*)::{L} AS attempted, count_if(o = 'ok')::{L} AS succeeded, count_if(o = 'pending')::{L} AS pending
    FROM (SELECT (user_id % 4)::VARCHAR AS g, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'ok' END AS o FROM events) GROUP BY GROUPING SETS ((), (g))
)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("ok")
    e = read(spark, sf_dir, "events", "user_id", "event_type").select((F.col("user_id") % 4).cast("string").alias("grp"), outcome.alias("o"))
    return stats.detail_stats(e, "grp", "o")


@register("detail_stats_grouping_sets", f"WITH {STATS_SQL} SELECT *, attempted - succeeded - pending AS failed FROM s")
def detail_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@register("outage_flags", f"WITH {STATS_SQL} SELECT grp, CASE WHEN succeeded = 0 AND attempted - pending > 0 THEN 'ERROR' ELSE 'OK' END AS general, CASE WHEN attempted > 0 AND succeeded = 0 AND pending = 0 THEN 'ERROR' WHEN attempted - succeeded - pending > 0 THEN 'WARN' ELSE 'OK' END AS strict FROM s")
def outage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, s, p, f = (F.col(c) for c in ("attempted", "succeeded", "pending", "failed"))
    return _stats(spark, sf_dir).select("grp", stats.outage(a, s, p).alias("general"), stats.strict_outage(a, s, p, f).alias("strict"))


@register("ai_stats", f"SELECT count_if(length(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) >= 200)::{L} AS targets, count_if(quality = 1 AND length(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) >= 200)::{L} AS summarised, greatest(count_if(length(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) >= 200) - count_if(quality = 1 AND length(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) >= 200), 0)::{L} AS fallback FROM documents LEFT JOIN labels USING (doc_id)")
def ai_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "doc_id", "text").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    target = F.length(T.squish("text")) >= 200
    return stats.ai_stats(df, target, target & (F.col("quality") == 1))


@register("source_counts", f"SELECT source AS source_key, count(*)::{L} AS n FROM documents GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "source").groupBy(F.col("source").alias("source_key")).agg(F.count("*").alias("n"))


@register("agency_count_distinct", f"SELECT count(DISTINCT trim(split_part(name, '·', 1)))::{L} AS agencies, count(*)::{L} AS sources FROM (SELECT r_name || ' · ' || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE name <> ''")
def agency_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat_ws(" · ", "r_name", "n_name").alias("name")).where("name <> ''").agg(F.count_distinct(T.agency("name")).alias("agencies"), F.count("*").alias("sources"))


@register("top_source_first_tie", f"WITH c AS (SELECT source, min(doc_id) AS o, count(*)::{L} AS n FROM documents GROUP BY 1) SELECT (SELECT source FROM c ORDER BY n DESC, o LIMIT 1) AS top, max(n) AS top_n, (count(*) - 1)::{L} AS others FROM c")
def top_source_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "documents", "source", "doc_id").groupBy("source").agg(F.min("doc_id").alias("o"), F.count("*").alias("n"))
    return stats.top_first(c, "source", "n", "o")


@register("any_summary_flag", "SELECT source AS source_key, coalesce(bool_or(quality = 1), false) AS any_summary FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def any_summary_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "doc_id", "source").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return df.groupBy(F.col("source").alias("source_key")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("any_summary"))


@register("page_all_seen", f"WITH {POSTS_SQL}, {SEEN_SQL} SELECT p.source_key, page::{L} AS page, bool_and(s.doc_id IS NOT NULL) AS all_seen FROM posts p LEFT JOIN seen s ON s.source_key = p.source_key AND s.doc_id = p.doc_id GROUP BY 1, 2")
def page_all_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relops.flag_seen(posts(spark, sf_dir), seen(spark, sf_dir), ["source_key", "doc_id"])
    return df.groupBy("source_key", F.col("page").cast("long").alias("page")).agg(F.every("seen").alias("all_seen"))


@register("verify_verdict", f"SELECT user_id, count(*)::{L} AS sampled, CASE WHEN count_if(event_type <> 'error') = 0 THEN 'FAIL' WHEN count_if(event_type = 'error') > 0 THEN 'PARTIAL' ELSE 'OK' END AS verdict, max(length(props))::{L} AS longest FROM events GROUP BY 1")
def verify_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_type", "props").groupBy("user_id").agg(F.count("*").alias("sampled"), F.count_if(F.col("event_type") == "error").alias("bad"), F.max(F.length("props")).cast("long").alias("longest"))
    return e.select("user_id", "sampled", classify.verdict(F.col("bad") > 0, F.col("sampled") > F.col("bad"), F.col("sampled")).alias("verdict"), "longest")


@register("pagination_differs", f"WITH {POSTS_SQL} SELECT source_key, count(*)::{L} AS fresh, count(*) > 0 AS differs FROM posts p WHERE page = 2 AND NOT EXISTS (SELECT 1 FROM posts q WHERE q.source_key = p.source_key AND q.page = 1 AND q.doc_id = p.doc_id) GROUP BY 1")
def pagination_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    second = relops.new_items(p.where("page = 2"), p.where("page = 1"), ["source_key", "doc_id"])
    return second.groupBy("source_key").agg(F.count("*").alias("fresh"), (F.count("*") > 0).alias("differs"))


@register("multi_source_union", f"SELECT 'doc' AS kind, doc_id AS id, n_chars AS size FROM documents UNION ALL SELECT 'page', page_id, length(html)::{L} FROM pages")
def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "n_chars").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return d.unionByName(read(spark, sf_dir, "pages", "page_id", "html").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("size")))


# --- joins by id -------------------------------------------------------------

REQUESTED = "SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id % 3 = 0"
RETURNED = "SELECT conv_id AS id, turn, text FROM conversations WHERE role = 'assistant'"


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")).distinct()


def _returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("id"), "turn", "text")


@register("summary_map_by_id", f"WITH q AS ({REQUESTED}), r AS ({RETURNED}), o AS (SELECT id, min(text) AS text FROM r GROUP BY 1 HAVING count(*) = 1) SELECT q.id, o.text AS summary FROM q LEFT JOIN o USING (id)")
def summary_map_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by id, never by place; an id that came twice has none."""
    once = relops.drop_all_duplicates(_returned(spark, sf_dir), ["id"])
    return _requested(spark, sf_dir).join(once.select("id", F.col("text").alias("summary")), "id", "left")


@register("missing_retry", f"WITH q AS ({REQUESTED}), r AS ({RETURNED}) SELECT id FROM q WHERE id NOT IN (SELECT id FROM r WHERE id IS NOT NULL)")
def missing_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.new_items(_requested(spark, sf_dir), _returned(spark, sf_dir), ["id"])


@register("unknown_rejected", f"WITH q AS ({REQUESTED}), r AS ({RETURNED}) SELECT id, turn, id IN (SELECT id FROM q) AS known FROM r")
def unknown_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.flag_seen(_returned(spark, sf_dir), _requested(spark, sf_dir), ["id"], "known").select("id", "turn", "known")


@register(
    "label_value_zip",
    "WITH a AS (SELECT l_orderkey AS order_key, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_linestatus) AS ls, list(l_linestatus ORDER BY l_linenumber, l_returnflag, l_linestatus) FILTER (WHERE l_linenumber > 1) AS vs FROM lineitem GROUP BY 1), z AS (SELECT order_key, unnest(range(0, least(len(ls), coalesce(len(vs), 0)))) AS pos, ls, vs FROM a), f AS (SELECT order_key, pos, ls[pos + 1] AS label, vs[pos + 1] AS value FROM z) SELECT order_key, label, value FROM (SELECT *, row_number() OVER (PARTITION BY order_key, label ORDER BY pos) AS k FROM f) WHERE k = 1",
)
def label_value_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs two unequal lists by place up to the shorter one; a label's first value counts."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = li.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("r"))
    rows = rows.select("order_key", F.transform("r", lambda x: x["l_returnflag"]).alias("ls"), F.transform(F.filter("r", lambda x: x["l_linenumber"] > 1), lambda x: x["l_linestatus"]).alias("vs"))
    return relops.first_wins(relops.positional_zip(rows, "ls", "vs", "order_key"), ["order_key", "label"], ["pos"]).select("order_key", "label", "value")


@register("best_rank_pick", f"SELECT order_key, line, p FROM (SELECT l_orderkey AS order_key, l_linenumber::{L} AS line, CASE WHEN l_quantity >= 30 THEN 'FOUND' WHEN l_quantity >= 20 THEN 'EMPTY' WHEN l_quantity >= 10 THEN 'UNEXPECTED' ELSE 'MISSING' END AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity >= 30 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def best_rank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    q = F.col("l_quantity")
    p = F.when(q >= 30, "FOUND").when(q >= 20, "EMPTY").when(q >= 10, "UNEXPECTED").otherwise("MISSING")
    li = li.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), p.alias("p"))
    best = li.groupBy("order_key").agg(F.max(F.struct(classify.rank(F.col("p")).alias("r"), (-F.col("line")).alias("at"), "p")).alias("m"))
    return best.select("order_key", (-F.col("m.at")).alias("line"), F.col("m.p").alias("p"))


@register("longest_name_pick", "SELECT p_brand AS brand, p_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS k FROM part) WHERE k = 1")
def longest_name_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_brand", "p_name", "p_partkey")
    best = p.groupBy(F.col("p_brand").alias("brand")).agg(F.max(F.struct(F.length("p_name").alias("n"), (-F.col("p_partkey")).alias("at"), "p_name")).alias("m"))
    return best.select("brand", F.col("m.p_name").alias("name"))


ACCENTS = (("AFRICA", "#a33"), ("ASIA", "#3a3"), ("AMERICA", "#33a"), ("AR", "#aa3"))


@register("accent_contains_lookup", "SELECT n_nationkey AS key, CASE " + " ".join(f"WHEN contains(r_name || n_name, '{k}') THEN '{v}'" for k, v in ACCENTS) + " ELSE '#555' END AS accent FROM nation JOIN region ON n_regionkey = r_regionkey")
def accent_contains_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("key"), relops.first_contained(F.concat("r_name", "n_name"), ACCENTS, "#555").alias("accent"))


@register("source_config_join", "SELECT s_suppkey AS key, n_name AS name, r_name AS grp, n_nationkey % 2 = 0 AS enrich FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0")
def source_config_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 5 <> 0")
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(config, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("grp"), (F.col("n_nationkey") % 2 == 0).alias("enrich"))


@register(
    "digest_text",
    f"""WITH p AS (SELECT source AS source_key, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS s, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source_key, '[' || source_key || '] ' || n || chr(10) || string_agg('- ' || CASE WHEN length(s) > 40 THEN substr(s, 1, 40) || ' …' ELSE s END, chr(10) ORDER BY k) AS block FROM p WHERE k <= 3 GROUP BY source_key, n""",
)
def digest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "source", "doc_id", "text").withColumnRenamed("source", "source_key")
    n = df.groupBy("source_key").agg(F.count("*").alias("n"))
    top = relops.newest(df, ["source_key"], [F.desc("doc_id")], 3)
    return render.text_blocks(top.select("source_key", (-F.col("doc_id")).alias("pos"), T.truncate(T.squish("text"), 40).alias("line")), n, "source_key", "pos", "line")


from . import details, shaping  # noqa: E402, F401  register parts 2 and 3

"""Queries that merge records of several sources, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import merging
from tallyloom.plans.queries import _ORD, _SEG, _ST
from tallyloom.sources.tables import order_statements, read, segments, statements

FIELDS = ["revenue", "cost", "tax"]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of entries: lines, with fields and quarters missing, and orders, which know revenue alone."""
    q, c = F.col("q_ord"), F.col("company")
    lines = statements(spark, sf_dir).filter((q + c) % 6 != 0).select("company", "q_ord", F.lit("lines").alias("source"), F.lit(0).alias("source_order"), F.when(q % 3 != 0, F.col("revenue")).alias("revenue"), F.when(c % 4 != 0, F.col("cost")).alias("cost"), "tax", (q % 8).alias("n_breakdown"), (q % 2 == 0).alias("has_url"), (c % 2 == 0).alias("has_flags"), F.lit(80).alias("priority"))
    null = F.lit(None).cast("double")
    orders = order_statements(spark, sf_dir).select("company", "q_ord", F.lit("orders").alias("source"), F.lit(1).alias("source_order"), "revenue", F.round(F.col("revenue") / 2, 3).alias("cost"), null.alias("tax"), F.lit(0).cast("long").alias("n_breakdown"), F.lit(True).alias("has_url"), F.lit(True).alias("has_flags"), F.lit(110).alias("priority"))
    return lines.unionByName(orders)


def representative_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.representative(_sources(spark, sf_dir), FIELDS)


def fuse_coalesce_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.coalesce_order(_sources(spark, sf_dir), FIELDS)


def fuse_source_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.source_usage(fuse_coalesce_order(spark, sf_dir), FIELDS)


def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statements(spark, sf_dir).filter((F.col("q_ord") + F.col("company")) % 6 != 0)
    return merging.outer_merge(own, order_statements(spark, sf_dir).filter(F.col("q_ord") % 5 != 0), ["revenue"])


def fuse_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_source = _sources(spark, sf_dir)
    return merging.fill_only(by_source.filter(F.col("source") == "lines"), by_source.filter(F.col("source") == "orders"), FIELDS)


def overlay_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _sources(spark, sf_dir).filter(F.col("source") == "lines")
    defaults = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("company"), F.when(F.col("n_regionkey") == 1, F.lit(1.5)).alias("cost"), F.lit(None).cast("double").alias("revenue"), F.lit(None).cast("double").alias("tax"))
    return merging.overlay(base, defaults, order_statements(spark, sf_dir).filter(F.col("q_ord") % 5 == 0).select("company", "q_ord", "revenue", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("tax")), FIELDS)


def preserve_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = statements(spark, sf_dir).select("company", "q_ord", "revenue").filter((F.col("q_ord") + F.col("company")) % 3 != 0)
    return merging.preserve_missing(fresh, order_statements(spark, sf_dir), ["company", "q_ord"])


def largest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("filed"), "event_id", "value")
    return merging.largest_member(rows, ["user_id", "event_type"], "event_id")


def reporting_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("company"), F.when(F.col("event_id") % 2 == 0, "USD").otherwise(F.col("event_type")).alias("currency"), (F.col("event_id") % 3 + 2).alias("weight")).agg(F.count(F.lit(1)).alias("n_facts"))
    return merging.reporting_currency(votes)


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.sum("value") > 150, "success").when(F.count(F.lit(1)) > 1, "empty").otherwise("error")
    attempts = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("company"), F.col("event_type").alias("source")).agg(status.alias("status"))
    return merging.first_success(attempts.withColumn("source_order", F.ascii("source")))


def stale_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = read(spark, sf_dir, "events").select("user_id", F.col("ts").alias("filed"), F.col("event_id").alias("accession"))
    return merging.stale(merging.newest_marker(filings.filter(F.col("accession") % 4 != 0), "user_id"), merging.newest_marker(filings, "user_id"), "user_id")


def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment are rebuilt; of the others those of the current version stay."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", (F.col("c_custkey") % 3).alias("version"))
    rebuilt = customers.filter(F.col("c_mktsegment") == "BUILDING").withColumn("version", F.lit(2).cast("long"))
    return merging.incremental(rebuilt, customers, 2, "c_custkey")


def unexpired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return merging.unexpired(events.select("event_id", "ts"), events.agg(F.max("ts")).scalar(), 7 * 86400).select("event_id")


def member_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.compare_members(segments(spark, sf_dir))


QUERIES = {f.__name__: f for f in (representative_entry, fuse_coalesce_order, fuse_source_usage, outer_merge, fuse_provenance, overlay_defaults, preserve_history, largest_member, reporting_currency, first_success, stale_detection, incremental_build, unexpired_rows, member_sets)}

_SOURCES = f"""{_ST}, {_ORD}, src AS (
    SELECT company, q_ord, 'lines' AS source, 0 AS o, CASE WHEN q_ord % 3 <> 0 THEN revenue END AS revenue, CASE WHEN company % 4 <> 0 THEN cost END AS cost, tax, q_ord % 8 AS n, q_ord % 2 = 0 AS u, company % 2 = 0 AS f, 80 AS p FROM st WHERE (q_ord + company) % 6 <> 0
    UNION ALL SELECT company, q_ord, 'orders', 1, revenue, round(revenue / 2, 3), NULL, 0, true, true, 110 FROM ord)"""
_FUSED = f"""{_SOURCES}, l AS (SELECT * FROM src WHERE o = 0), r AS (SELECT * FROM src WHERE o = 1),
    m AS (SELECT company, q_ord, coalesce(l.source, r.source) AS template, coalesce(l.revenue, r.revenue) AS revenue, coalesce(l.cost, r.cost) AS cost, coalesce(l.tax, r.tax) AS tax,
        CASE WHEN l.revenue IS NOT NULL THEN 'lines' WHEN r.revenue IS NOT NULL THEN 'orders' END AS revenue_source, CASE WHEN l.cost IS NOT NULL THEN 'lines' WHEN r.cost IS NOT NULL THEN 'orders' END AS cost_source, CASE WHEN l.tax IS NOT NULL THEN 'lines' END AS tax_source
        FROM l FULL JOIN r USING (company, q_ord))"""
_NEWEST = "SELECT user_id, max((ts, event_id)) AS m FROM events {0} GROUP BY 1"

ORACLE_SQL = {
    "representative_entry": f"""WITH {_SOURCES}, s AS (SELECT *, round((revenue IS NOT NULL)::INT + (cost IS NOT NULL)::INT + (tax IS NOT NULL)::INT + 0.2::DOUBLE * least(n, 6) + 0.5::DOUBLE * u::INT + 0.25::DOUBLE * f::INT + p / 100, 6) AS score FROM src)
        SELECT company, q_ord, source, score, revenue, cost, tax FROM s QUALIFY row_number() OVER (PARTITION BY company, q_ord ORDER BY score DESC, o) = 1""",
    "fuse_coalesce_order": f"""WITH {_FUSED} SELECT *, CAST(coalesce((revenue_source <> template)::INT, 0) + coalesce((cost_source <> template)::INT, 0) + coalesce((tax_source <> template)::INT, 0) AS BIGINT) AS n_overrides FROM m""",
    "fuse_source_usage": f"""WITH {_FUSED}, u AS (UNPIVOT (SELECT company, q_ord, revenue_source, cost_source, tax_source FROM m) ON revenue_source, cost_source, tax_source INTO NAME field VALUE source),
        x AS (SELECT company, q_ord, count(DISTINCT source) > 1 AS mixed FROM u GROUP BY 1, 2)
        SELECT source, CAST(count(*) AS BIGINT) AS n_fields, CAST(count(DISTINCT (company, q_ord)) FILTER (mixed) AS BIGINT) AS n_mixed FROM u JOIN x USING (company, q_ord) GROUP BY 1""",
    "outer_merge": f"""WITH {_ST}, {_ORD} SELECT company, q_ord, coalesce(o.revenue, s.revenue) AS revenue, cost, tax FROM (SELECT * FROM st WHERE (q_ord + company) % 6 <> 0) s FULL JOIN (SELECT * FROM ord WHERE q_ord % 5 <> 0) o USING (company, q_ord)""",
    "fuse_provenance": f"""WITH {_SOURCES}, l AS (SELECT * FROM src WHERE o = 0), r AS (SELECT * FROM src WHERE o = 1)
        SELECT company, q_ord, coalesce(l.revenue, r.revenue) AS revenue, coalesce(l.cost, r.cost) AS cost, coalesce(l.tax, r.tax) AS tax,
        concat_ws(',', CASE WHEN l.revenue IS NULL AND r.revenue IS NOT NULL THEN 'revenue' END, CASE WHEN l.cost IS NULL AND r.cost IS NOT NULL THEN 'cost' END, CASE WHEN l.tax IS NULL AND r.tax IS NOT NULL THEN 'tax' END) AS filled
        FROM l FULL JOIN r USING (company, q_ord)""",
    "overlay_defaults": f"""WITH {_SOURCES} SELECT l.company, l.q_ord, coalesce(q.revenue, l.revenue) AS revenue, coalesce(CASE WHEN n_regionkey = 1 THEN 1.5::DOUBLE END, l.cost) AS cost, l.tax
        FROM src l LEFT JOIN nation ON n_nationkey = l.company LEFT JOIN ord q ON q.company = l.company AND q.q_ord = l.q_ord AND q.q_ord % 5 = 0 WHERE l.o = 0""",
    "preserve_history": f"""WITH {_ST}, {_ORD} SELECT company, q_ord, CASE WHEN s.revenue IS NOT NULL THEN s.revenue ELSE ord.revenue END AS revenue FROM (SELECT * FROM st WHERE (q_ord + company) % 3 <> 0) s FULL JOIN ord USING (company, q_ord)""",
    "largest_member": "SELECT user_id, event_type, ts AS filed, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, ts DESC, event_id) = 1",
    "reporting_currency": """WITH s AS (SELECT user_id AS company, CASE WHEN event_id % 2 = 0 THEN 'USD' ELSE event_type END AS currency, CAST(sum(event_id % 3 + 2) AS BIGINT) AS score FROM events GROUP BY 1, 2)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY company ORDER BY score DESC, currency = 'USD', currency DESC) = 1""",
    "first_success": """WITH a AS (SELECT user_id AS company, event_type AS source, ascii(event_type) AS o, CASE WHEN sum(value) > 150 THEN 'success' WHEN count(*) > 1 THEN 'empty' ELSE 'error' END AS status FROM events GROUP BY 1, 2),
        f AS (SELECT company, min((o, source)) FILTER (status = 'success') AS won FROM a GROUP BY 1)
        SELECT company, won[2] AS source, coalesce(string_agg(a.source || ':' || status, ',' ORDER BY o, a.source) FILTER (won IS NULL OR o < won[1]), '') AS fallback FROM a JOIN f USING (company) GROUP BY company, won""",
    "stale_detection": f"SELECT r.user_id, coalesce(r.m <> l.m, true) AS stale FROM ({_NEWEST.format('')}) r LEFT JOIN ({_NEWEST.format('WHERE event_id % 4 <> 0')}) l USING (user_id)",
    "incremental_build": "SELECT c_custkey, c_mktsegment, c_acctbal, CAST(2 AS BIGINT) AS version FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 3 = 2",
    "unexpired_rows": "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
    "member_sets": f"""WITH {_SEG}, p AS (SELECT company, q_ord FROM seg GROUP BY 1, 2), w AS (SELECT a.company, a.q_ord FROM p a JOIN p b ON b.company = a.company AND b.q_ord = a.q_ord - 1),
        x AS (SELECT w.company, w.q_ord, coalesce(n.member, o.member) AS member, n.member IS NOT NULL AS now, o.member IS NOT NULL AS old FROM w JOIN (SELECT company, q_ord, member FROM seg UNION SELECT company, q_ord + 1, member FROM seg) u USING (company, q_ord)
            LEFT JOIN seg n ON n.company = w.company AND n.q_ord = w.q_ord AND n.member = u.member LEFT JOIN seg o ON o.company = w.company AND o.q_ord = w.q_ord - 1 AND o.member = u.member)
        SELECT company, q_ord, count(*) FILTER (now AND old) AS common, count(*) FILTER (old AND NOT now) AS missing, count(*) FILTER (now AND NOT old) AS extra FROM x GROUP BY 1, 2""",
}

"""Queries over the star schema and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import keys
from tallyloom.operators import breakdown, fusion, growth, periods
from tallyloom.sources.tables import order_statements, read, segments, sparse_statements, statements

Query = Callable[[SparkSession, str], DataFrame]

_Q = "CAST(year({0}) * 4 + quarter({0}) - 1 AS BIGINT)"
_NET = "CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"
_ST = f"""st AS (SELECT CAST(s_nationkey AS BIGINT) AS company, {_Q.format('l_shipdate')} AS q_ord, CAST(round(sum({_NET}), 3) AS DOUBLE) AS revenue,
    CAST(round(sum(CAST(l_extendedprice AS DECIMAL(15, 2)) * CAST(0.6 AS DECIMAL(2, 1))), 3) AS DOUBLE) AS cost, CAST(round(sum({_NET} * CAST(l_tax AS DECIMAL(4, 2))), 3) AS DOUBLE) AS tax
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
_SP = f"sp AS (SELECT l_partkey AS company, {_Q.format('l_shipdate')} AS q_ord, CAST(round(sum({_NET}), 3) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1, 2)"
_SEG = f"""seg AS (SELECT CAST(s_nationkey AS BIGINT) AS company, {_Q.format('l_shipdate')} AS q_ord, l_returnflag || l_linestatus AS member, CAST(round(sum({_NET}), 3) AS DOUBLE) AS value
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""
_ORD = f"""ord AS (SELECT CAST(c_nationkey AS BIGINT) AS company, {_Q.format('o_orderdate')} AS q_ord, CAST(round(sum(CAST(o_totalprice AS DECIMAL(15, 2))), 3) AS DOUBLE) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _growth_sql(condition: str) -> str:
    return f"""WITH {_SP} SELECT s.company, s.q_ord, s.revenue,
        CASE WHEN {condition.format('a')} THEN round((s.revenue / a.revenue - 1) * 100, 3) END AS qoq,
        CASE WHEN {condition.format('b')} THEN round((s.revenue / b.revenue - 1) * 100, 3) END AS yoy
        FROM sp s LEFT JOIN sp a ON a.company = s.company AND a.q_ord = s.q_ord - 1 LEFT JOIN sp b ON b.company = s.company AND b.q_ord = s.q_ord - 4"""


_CALENDAR = _growth_sql("{0}.revenue <> 0")
_POSITIONAL = f"""WITH {_SP}, l AS (SELECT *, lag(revenue, 1) OVER w AS a, lag(revenue, 4) OVER w AS b FROM sp WINDOW w AS (PARTITION BY company ORDER BY q_ord))
    SELECT company, q_ord, revenue, CASE WHEN a <> 0 AND revenue <> 0 THEN round((revenue / a - 1) * 100, 2) END AS qoq,
    CASE WHEN b <> 0 AND revenue <> 0 THEN round((revenue / b - 1) * 100, 2) END AS yoy FROM l"""


def _holes(df: DataFrame) -> DataFrame:
    """Statements with some fields missing, by quarter."""
    q = F.col("q_ord")
    gross = F.round(F.col("revenue") - F.col("cost"), 3)
    return df.select("company", "q_ord", "revenue", F.when(q % 3 != 0, F.col("cost")).alias("cost"), F.when(q % 3 != 1, gross).alias("gross"), F.when(q % 5 != 0, F.round(gross - F.col("tax"), 3)).alias("opex"), F.when(q % 5 != 1, F.round(gross - F.round(gross - F.col("tax"), 3), 3)).alias("op_income"), F.when(q % 2 == 0, F.round(gross - 1.25, 3)).alias("pretax"), "tax", F.when(q % 2 == 1, F.round(gross - 1.25 - F.col("tax"), 3)).alias("net"))


_HOLES = f"""{_ST}, h AS (SELECT company, q_ord, revenue, tax, CASE WHEN q_ord % 3 <> 0 THEN cost END AS cost, CASE WHEN q_ord % 3 <> 1 THEN round(revenue - cost, 3) END AS gross,
    CASE WHEN q_ord % 5 <> 0 THEN round(round(revenue - cost, 3) - tax, 3) END AS opex, CASE WHEN q_ord % 5 <> 1 THEN round(round(revenue - cost, 3) - round(round(revenue - cost, 3) - tax, 3), 3) END AS op_income,
    CASE WHEN q_ord % 2 = 0 THEN round(round(revenue - cost, 3) - 1.25::DOUBLE, 3) END AS pretax, CASE WHEN q_ord % 2 = 1 THEN round(round(revenue - cost, 3) - 1.25::DOUBLE - tax, 3) END AS net FROM st)"""


def derive_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.identities(_holes(statements(spark, sf_dir)))


def growth_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.positional(sparse_statements(spark, sf_dir))


def growth_calendar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.calendar(sparse_statements(spark, sf_dir), overwrite=False)


def growth_calendar_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.calendar(sparse_statements(spark, sf_dir), overwrite=True)


def growth_gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.gap_audit(growth_calendar_fill(spark, sf_dir))


def segment_growth_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.mix(segments(spark, sf_dir)).drop("qoq")


def segment_growth_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members against the company's revenue: RF told as shares, AF without growth in a quarter, some figures given."""
    rows = segments(spark, sf_dir).join(statements(spark, sf_dir).select("company", "q_ord", "revenue"), ["company", "q_ord"])
    share = F.col("member") == "RF"
    told = rows.withColumn("value", F.when(share, F.round(F.col("value") / F.col("revenue") * 100, 4)).otherwise(F.col("value")))
    given = told.withColumn("mode", F.when(share, "share")).withColumn("suppress_qoq", F.col("member") == "AF")
    return growth.mix(given.withColumn("yoy", F.when(F.col("q_ord") % 3 == 0, 1.25)).withColumn("qoq", F.when(F.col("q_ord") % 5 == 0, -2.5)))


def ytd_to_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.single_quarters(periods.cumulative(sparse_statements(spark, sf_dir)))


def contiguous_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.contiguous_tail(sparse_statements(spark, sf_dir))


def fuse_field_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    def offered(df: DataFrame, name: str, order: int, priority: int, url) -> DataFrame:
        return df.select("company", "q_ord", F.lit("revenue").alias("field"), F.col("revenue").alias("value"), F.lit(name).alias("source"), F.lit(order).alias("source_order"), F.lit(priority).alias("priority"), url.alias("has_url"), F.lit(True).alias("has_date"), (F.col("q_ord") % 2 == 0).alias("has_flags"))

    a, b = statements(spark, sf_dir), order_statements(spark, sf_dir)
    return fusion.fuse(offered(a, "lines", 0, 2, F.col("q_ord") % 3 == 0).unionByName(offered(b, "orders", 1, 3, F.col("company") % 2 == 0)))


def dedupe_latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.latest_filing(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "ts")


def _rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    rates = events.filter(F.col("event_id") % 7 == 0).groupBy(F.col("event_type").alias("currency"), "day").agg(F.max("value").alias("rate"))
    facts = events.select("event_id", F.col("event_type").alias("currency"), "day")
    return facts, rates


def fx_asof_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.as_of(*_rates(spark, sf_dir))


def fx_median_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, rates = _rates(spark, sf_dir)
    return fusion.median_fallback(facts.join(rates, ["currency", "day"], "left")).select("event_id", "currency", "rate")


def fit_to_total_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = segments(spark, sf_dir)
    return breakdown.fit_to_total(parts.join(order_statements(spark, sf_dir).select("company", "q_ord", F.col("revenue").alias("total")), ["company", "q_ord"]))


def topk_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), "l_returnflag").agg(F.sum("l_quantity").alias("value"))
    brands = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy(F.col("l_returnflag").alias("company"), F.col("p_brand").alias("member")).agg(F.sum("value").alias("value"))
    return breakdown.top_k_other(brands, 8)


def stack_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.stack(segments(spark, sf_dir))


def jaccard_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.alignment(segments(spark, sf_dir))


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.coverage(sparse_statements(spark, sf_dir))


def key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" & "), "p_type", F.lit("+ Segment"))
    return read(spark, sf_dir, "part").select("p_partkey", keys.taxonomy_key(name).alias("taxonomy"), keys.member_key(name).alias("member"), keys.ascii_key(name).alias("plain"), keys.chart_key(name).alias("chart"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (derive_identities, growth_positional, growth_calendar_fill, growth_calendar_overwrite, growth_gap_audit, segment_growth_mix, segment_growth_fill, ytd_to_quarter, contiguous_tail, fuse_field_argmax, dedupe_latest_filing, fx_asof_7d, fx_median_fallback, fit_to_total_remainder, topk_other, stack_prefix_sum, jaccard_alignment, coverage_audit, key_normalise)
}

_FACTS = """e AS (SELECT event_id, event_type AS currency, CAST(ts AS DATE) AS day, value FROM events),
    r AS (SELECT currency, day, max(value) AS rate FROM e WHERE event_id % 7 = 0 GROUP BY 1, 2)"""
_NAME = "p_name || ' & ' || p_type || '+ Segment'"

ORACLE_SQL: dict[str, str] = {
    "derive_identities": f"""WITH {_HOLES},
        g AS (SELECT * REPLACE (coalesce(gross, round(revenue - cost, 3)) AS gross) FROM h),
        c AS (SELECT * REPLACE (coalesce(cost, round(revenue - gross, 3)) AS cost) FROM g),
        o AS (SELECT * REPLACE (coalesce(op_income, round(gross - opex, 3)) AS op_income) FROM c),
        x AS (SELECT * REPLACE (coalesce(opex, round(gross - op_income, 3)) AS opex) FROM o),
        n AS (SELECT * REPLACE (coalesce(net, round(pretax - tax, 3)) AS net) FROM x)
        SELECT * REPLACE (coalesce(pretax, round(net + tax, 3)) AS pretax), CASE WHEN revenue <> 0 THEN round(100 * gross / revenue, 3) END AS gross_margin FROM n""",
    "growth_positional": _POSITIONAL,
    "growth_calendar_fill": _CALENDAR,
    "growth_calendar_overwrite": _growth_sql("{0}.revenue > 0 AND s.revenue > 0"),
    "growth_gap_audit": f"SELECT company, count(*) AS n_rows, count(*) FILTER (qoq IS NULL) AS no_qoq, count(*) FILTER (yoy IS NULL) AS no_yoy FROM ({_CALENDAR}) GROUP BY 1",
    "segment_growth_fill": f"""WITH {_ST}, {_SEG}, r AS (SELECT seg.*, st.revenue, round(value / revenue * 100, 4) AS told FROM seg JOIN st USING (company, q_ord)),
        v AS (SELECT company, q_ord, member, revenue, told, CASE WHEN member = 'RF' THEN round(told / 100 * revenue, 3) ELSE value END AS value FROM r),
        m AS (SELECT *, 100 * value / revenue AS share FROM v)
        SELECT m.company, m.q_ord, m.member, m.value, CASE WHEN m.member = 'RF' THEN round(m.told, 1) ELSE round(m.share, 1) END AS mix_pct, CASE WHEN y.value <> 0 THEN round(m.share - y.share, 1) + 0.0 END AS mix_delta,
        CASE WHEN m.q_ord % 3 = 0 THEN 1.25 WHEN y.value <> 0 THEN round((m.value / y.value - 1) * 100, 2) END AS yoy, CASE WHEN m.q_ord % 5 = 0 THEN -2.5 WHEN m.member <> 'AF' AND q.value <> 0 THEN round((m.value / q.value - 1) * 100, 2) END AS qoq
        FROM m LEFT JOIN m y ON y.company = m.company AND y.member = m.member AND y.q_ord = m.q_ord - 4 LEFT JOIN m q ON q.company = m.company AND q.member = m.member AND q.q_ord = m.q_ord - 1""",
    "segment_growth_mix": f"""WITH {_SEG}, m AS (SELECT *, 100 * value / sum(value) OVER (PARTITION BY company, q_ord) AS share FROM seg)
        SELECT m.company, m.q_ord, m.member, m.value, round(m.share, 1) AS mix_pct, round(m.share - p.share, 1) + 0.0 AS mix_delta, CASE WHEN p.value <> 0 THEN round((m.value / p.value - 1) * 100, 2) END AS yoy
        FROM m LEFT JOIN m p ON p.company = m.company AND p.member = m.member AND p.q_ord = m.q_ord - 4""",
    "ytd_to_quarter": f"""WITH {_SP}, y AS (SELECT company, q_ord, round(sum(revenue) OVER (PARTITION BY company, q_ord // 4 ORDER BY q_ord), 3) AS ytd FROM sp),
        l AS (SELECT *, lag(q_ord) OVER w AS pq, lag(ytd) OVER w AS py FROM y WINDOW w AS (PARTITION BY company, q_ord // 4 ORDER BY q_ord))
        SELECT company, q_ord, ytd, CASE WHEN q_ord % 4 = 0 THEN ytd WHEN pq = q_ord - 1 THEN round(ytd - py, 3) END AS value, q_ord % 4 <> 0 AS derived FROM l""",
    "contiguous_tail": f"""WITH {_SP}, i AS (SELECT *, q_ord - row_number() OVER (PARTITION BY company ORDER BY q_ord) AS run FROM sp),
        n AS (SELECT *, count(*) OVER (PARTITION BY company, run) AS size, max(run) OVER (PARTITION BY company) AS last FROM i),
        t AS (SELECT *, max(CASE WHEN run = last THEN size END) OVER (PARTITION BY company) AS last_size FROM n)
        SELECT company, q_ord, revenue FROM t WHERE last_size < 4 OR run = last""",
    "fuse_field_argmax": f"""WITH {_ST}, {_ORD}, c AS (
        SELECT company, q_ord, revenue AS value, 'lines' AS source, 0 AS o, 3 + 2 * (q_ord % 3 = 0)::INT + 0.5::DOUBLE * (q_ord % 2 = 0)::INT AS score FROM st
        UNION ALL SELECT company, q_ord, revenue, 'orders', 1, 4 + 2 * (company % 2 = 0)::INT + 0.5::DOUBLE * (q_ord % 2 = 0)::INT FROM ord)
        SELECT company, q_ord, 'revenue' AS field, value, source, score FROM c WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company, q_ord ORDER BY score DESC, o) = 1""",
    "dedupe_latest_filing": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1, 2",
    "fx_asof_7d": f"""WITH {_FACTS} SELECT e.event_id, e.currency, e.day, r.rate, r.day AS rate_day FROM e LEFT JOIN r ON r.currency = e.currency AND r.day BETWEEN e.day - 7 AND e.day
        QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY r.day DESC NULLS LAST) = 1""",
    "fx_median_fallback": f"""WITH {_FACTS}, j AS (SELECT e.event_id, e.currency, r.rate FROM e LEFT JOIN r USING (currency, day))
        SELECT event_id, currency, coalesce(rate, round(median(rate) OVER (PARTITION BY currency), 6)) AS rate FROM j""",
    "fit_to_total_remainder": f"""WITH {_SEG}, {_ORD}, s AS (SELECT seg.*, ord.revenue AS total, round(value * ord.revenue / sum(value) OVER (PARTITION BY seg.company, seg.q_ord), 3) AS scaled FROM seg JOIN ord USING (company, q_ord)),
        p AS (SELECT *, coalesce(sum(scaled) OVER (PARTITION BY company, q_ord ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY company, q_ord ORDER BY member) = count(*) OVER (PARTITION BY company, q_ord) AS is_last FROM s)
        SELECT company, q_ord, member, value, total, round(CASE WHEN is_last THEN total - before ELSE scaled END, 3) AS fitted FROM p""",
    "topk_other": """WITH b AS (SELECT l_returnflag AS company, p_brand AS member, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY value DESC, member) AS n FROM b)
        SELECT company, CASE WHEN n <= 8 THEN member ELSE 'other' END AS member, round(sum(value), 2) AS value, count(*) AS n_members FROM k GROUP BY 1, 2""",
    "stack_prefix_sum": f"""WITH {_SEG} SELECT *, round(sum(value) OVER w, 3) AS "end", round(sum(value) OVER w - value, 3) + 0.0 AS start FROM seg WINDOW w AS (PARTITION BY company, q_ord ORDER BY value DESC, member ROWS UNBOUNDED PRECEDING)""",
    "jaccard_alignment": f"""WITH {_SEG}, s AS (SELECT company, q_ord, list(DISTINCT member) AS own FROM seg GROUP BY 1, 2), a AS (SELECT company, arg_max(own, q_ord) AS anchor FROM s GROUP BY 1),
        j AS (SELECT company, q_ord, len(own) AS n_members, len(list_intersect(own, anchor)) / len(list_distinct(list_concat(own, anchor))) AS x FROM s JOIN a USING (company))
        SELECT company, q_ord, n_members, round(x, 6) AS jaccard, x >= 0.58 AS comparable FROM j""",
    "coverage_audit": f"""WITH {_SP} SELECT company, count(*) AS n_quarters, min(q_ord) AS first_q, max(q_ord) AS last_q, max(q_ord) - min(q_ord) + 1 - count(*) AS n_missing, (SELECT max(q_ord) FROM sp) - max(q_ord) AS lag FROM sp GROUP BY 1""",
    "key_normalise": f"""SELECT p_partkey, regexp_replace(lower({_NAME}), '[^a-z0-9一-鿿]', '', 'g') AS taxonomy,
        regexp_replace(regexp_replace(lower({_NAME}), '[^a-z0-9一-鿿]', '', 'g'), '(member|segment)$', '') AS member,
        regexp_replace(lower({_NAME}), '[^a-z0-9]', '', 'g') AS plain, regexp_replace(lower(replace(replace({_NAME}, '&', 'and'), '+', 'plus')), '[^a-z0-9]', '', 'g') AS chart FROM part""",
}

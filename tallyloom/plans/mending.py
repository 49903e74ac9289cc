"""Queries that repair and check breakdowns, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import breakdown, checks, repairs
from tallyloom.plans.queries import _ORD, _SEG, _ST
from tallyloom.sources.tables import order_statements, read, segments, statements

QUARTER = ["company", "q_ord"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with totals from a half to over twice their sum."""
    total = F.round(F.col("revenue") * (0.5123457 + F.col("q_ord") % 10 / 5), 3)
    return segments(spark, sf_dir).join(statements(spark, sf_dir).select(*QUARTER, "revenue", total.alias("total")), QUARTER)


def scale_or_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.scale_or_residual(_parts(spark, sf_dir), 0.62)


def reconcile_to_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.when(F.col("q_ord") % 7 == 0, None).when(F.col("q_ord") % 7 == 1, 0.01).otherwise(F.col("total"))
    return repairs.reconcile_to_total(_parts(spark, sf_dir).withColumn("total", total))


def raw_millions(spark: SparkSession, sf_dir: str) -> DataFrame:
    slip = F.when(F.col("q_ord") % 4 == 0, F.col("value") * 1000).otherwise(F.col("value"))
    return repairs.raw_millions(_parts(spark, sf_dir).withColumn("value", F.round(slip, 3))).select(*QUARTER, "member", "value", "slipped")


def roll_up_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.roll_up(segments(spark, sf_dir), "N", ["NF", "NO"])


def from_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.from_shares(_parts(spark, sf_dir).withColumn("share", F.col("value") / F.col("revenue")))


def q4_outlier_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourth quarters of a third of the companies hold four times their revenue and members, of another three times the revenue alone."""
    last, kind = F.col("q_ord") % 4 == 3, F.col("company") % 3
    own = statements(spark, sf_dir).withColumn("revenue", F.when(last & (kind == 0), F.round(F.col("revenue") * 4, 3)).when(last & (kind == 1), F.round(F.col("revenue") * 3, 3)).otherwise(F.col("revenue")))
    rows = segments(spark, sf_dir).filter(F.col("member") != "NF").withColumn("value", F.when(last & (kind == 0), F.round(F.col("value") * 4, 3)).otherwise(F.col("value")))
    return repairs.q4_outliers(own, rows)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by flag alone with the revenue of the quarters, some of which lack one of the three."""
    flags = segments(spark, sf_dir).groupBy(*QUARTER, F.substring("member", 1, 1).alias("member")).agg(F.round(F.sum("value"), 3).alias("value"))
    rows = flags.join(statements(spark, sf_dir).select(*QUARTER, "revenue"), QUARTER)
    lacking = ((F.col("q_ord") % 5 == 0) & (F.col("member") == "N")) | ((F.col("q_ord") % 7 == 0) & (F.col("member") == "R"))
    return rows.filter(~lacking | (F.col("company") % 4 == 0))


def residual_template_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.impute_member(_sparse(spark, sf_dir), ["N", "R"])


def residual_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.residual_vote(_sparse(spark, sf_dir), {"A": ["R"]})


def nearest_quarter_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).filter((F.col("q_ord") + F.col("company")) % 5 > 1)
    return repairs.nearby(statements(spark, sf_dir).select(*QUARTER, "revenue"), rows)


def breakdown_fuse_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of each quarter's members: one without the last, one with higher values."""
    rows = _parts(spark, sf_dir).withColumn("total", F.round(F.col("revenue") * (0.9012345 + F.col("q_ord") % 3 / 10), 3))
    one = rows.filter(F.col("member") != "RF").select(*QUARTER, F.lit("a").alias("source"), F.lit(120.0).alias("priority"), "member", "value", "total")
    two = rows.filter(F.col("company") % 2 == 0).select(*QUARTER, F.lit("b").alias("source"), F.lit(118.0).alias("priority"), "member", F.round(F.col("value") * 1.1234567, 3).alias("value"), "total")
    return repairs.fuse_breakdowns(one.unionByName(two))


def suspicious_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("rnd", "fulfillment", "sales_marketing", "finance_expense", "ga", "other")))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_linenumber").cast("long").alias("q_ord"), F.element_at(names, (F.col("l_orderkey") % 6 + 1).cast("int")).alias("member"), F.col("l_tax").alias("value"), (F.col("l_suppkey") % 3 * F.col("l_linenumber") * 5.0).alias("total"))
    return breakdown.suspicious(lines, QUARTER)


def _statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose fields don't always agree, and lack some."""
    q, c = F.col("q_ord"), F.col("company")
    r3 = lambda x: F.round(x, 3)
    df = statements(spark, sf_dir).withColumn("gross", r3(F.col("revenue") - F.col("cost"))).withColumn("opex", r3(F.col("revenue") * 0.1)).withColumn("op_income", r3(F.col("gross") - F.col("opex"))).withColumn("non_op", r3(F.col("revenue") * 0.01)).withColumn("pretax", r3(F.col("op_income") + F.col("non_op"))).withColumn("net", r3(F.col("pretax") - F.col("tax")))
    rate = lambda a, b: r3(F.col(a) / F.col(b) * 100)
    df = df.withColumn("gross_margin", rate("gross", "revenue")).withColumn("op_margin", rate("op_income", "revenue")).withColumn("net_margin", rate("net", "revenue")).withColumn("tax_rate", rate("tax", "pretax"))
    return df.withColumn("cost", F.when((q + c) % 4 != 0, F.col("cost"))).withColumn("gross", F.when(q % 5 == 0, r3(F.col("gross") * 1.25)).otherwise(F.col("gross"))).withColumn("net", F.when(q % 6 != 0, F.col("net"))).withColumn("tax_rate", F.when(c % 3 != 0, F.col("tax_rate") + c)).withColumn("non_op", F.when(c % 5 != 0, F.col("non_op")))


def statement_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.validation(_statement(spark, sf_dir))


def company_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.company_summary(statement_validation(spark, sf_dir))


def structure_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, rows = _statement(spark, sf_dir), segments(spark, sf_dir)
    revenue = own.withColumn("revenue", F.when(F.col("q_ord") % 5 == 0, F.round(F.col("revenue") * 1.1, 3)).otherwise(F.col("revenue")))
    details = rows.select(*QUARTER, F.col("member").alias("target"), F.round(F.col("value") * F.when(F.col("q_ord") % 3 == 0, 0.9).otherwise(1.0), 3).alias("value"))
    expenses = rows.filter(F.col("company") % 2 == 0).select(*QUARTER, "member", F.round(F.col("value") * 0.102, 3).alias("value"))
    return checks.structure(revenue, rows, details, expenses, company_validation(spark, sf_dir))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = segments(spark, sf_dir).filter(F.col("member") != "RF").groupBy(*QUARTER).agg(F.round(F.sum("value"), 3).alias("segment_sum"))
    df = _statement(spark, sf_dir).join(sums, QUARTER, "left").withColumn("cost_sum", F.round(F.col("revenue") * 0.3, 3)).withColumn("opex_sum", F.round(F.col("opex") * (F.col("q_ord") % 10 / 10), 3)).withColumn("n_sources", F.col("company") % 9)
    return checks.quality(df)


def degenerate_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.col("q_ord") % 3 == 0
    df = _statement(spark, sf_dir)
    for f in checks.CORE[1:7]:
        df = df.withColumn(f, F.when(flat, F.col("revenue")).otherwise(F.col(f)))
    return checks.degenerate(df, checks.CORE)


def renderable_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _statement(spark, sf_dir).withColumn("revenue", F.when((F.col("q_ord") % 2 == 0) | (F.col("company") == 3), 0.01).otherwise(F.col("revenue")))
    return checks.low_quality(checks.renderable(df).withColumn("is_summary", F.col("q_ord") % 3 == 0).withColumn("tax", F.when(F.col("q_ord") % 6 != 1, F.col("tax"))).withColumn("pretax", F.lit(None).cast("double")).withColumn("op_income", F.lit(None).cast("double"))).select(*QUARTER, "revenue", "low_quality")


def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("company"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("long").alias("q_ord")).distinct()
    return checks.audit(breakdown.coverage(rows), 20)


def isolated_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.isolated_schemas(_sparse(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (scale_or_residual, reconcile_to_total, raw_millions, roll_up_children, from_shares, q4_outlier_repair, residual_template_impute, residual_vote, nearest_quarter_interpolate, breakdown_fuse_residual, suspicious_breakdown, statement_validation, company_validation, structure_validation, quality_score, degenerate_entry, renderable_quarters, dataset_audit, isolated_schemas)
}

_PARTS = f"{_SEG}, {_ST}, prt AS (SELECT seg.*, st.revenue, round(st.revenue * (0.5123457::DOUBLE + q_ord % 10 / 5), 3) AS total FROM seg JOIN st USING (company, q_ord))"
_W = "OVER (PARTITION BY company, q_ord)"
_SPARSE = f"""{_SEG}, {_ST}, flg AS (SELECT company, q_ord, member[1] AS member, round(sum(value), 3) AS value FROM seg GROUP BY 1, 2, 3),
    sps AS (SELECT flg.*, st.revenue FROM flg JOIN st USING (company, q_ord) WHERE NOT ((q_ord % 5 = 0 AND member = 'N') OR (q_ord % 7 = 0 AND member = 'R')) OR company % 4 = 0)"""
_STATEMENT = f"""{_ST}, s1 AS (SELECT *, round(revenue - cost, 3) AS gross, round(revenue * 0.1::DOUBLE, 3) AS opex, round(revenue * 0.01::DOUBLE, 3) AS non_op FROM st), s2 AS (SELECT *, round(gross - opex, 3) AS op_income FROM s1),
    s3 AS (SELECT *, round(op_income + non_op, 3) AS pretax FROM s2), s4 AS (SELECT *, round(pretax - tax, 3) AS net FROM s3), s5 AS (SELECT *, round(gross / revenue * 100, 3) AS gross_margin, round(op_income / revenue * 100, 3) AS op_margin, round(net / revenue * 100, 3) AS net_margin, round(tax / pretax * 100, 3) AS tax_rate FROM s4),
    stm AS (SELECT company, q_ord, revenue, tax, opex, op_income, pretax, gross_margin, op_margin, net_margin, CASE WHEN (q_ord + company) % 4 <> 0 THEN cost END AS cost, CASE WHEN q_ord % 5 = 0 THEN round(gross * 1.25::DOUBLE, 3) ELSE gross END AS gross, CASE WHEN q_ord % 6 <> 0 THEN net END AS net,
        CASE WHEN company % 3 <> 0 THEN tax_rate + company END AS tax_rate, CASE WHEN company % 5 <> 0 THEN non_op END AS non_op FROM s5)"""


def _check(code: str, told: str, derived: str, least: float) -> str:
    return f"CASE WHEN abs(round({told} - ({derived}), 3)) <= greatest({least}::DOUBLE, abs({told}) * 0.03::DOUBLE) THEN '' WHEN {told} - ({derived}) IS NOT NULL THEN '{code}' END"


_CHECKS = ", ".join(
    _check(*c)
    for c in (
        ("revenue-minus-cost-equals-gross", "gross", "revenue - cost", 0.12),
        ("gross-minus-opex-equals-operating", "op_income", "gross - opex", 0.12),
        ("operating-plus-nonoperating-equals-pretax", "pretax", "op_income + non_op", 0.12),
        ("pretax-minus-tax-equals-net", "net", "pretax - tax", 0.12),
        ("gross-margin-check", "gross_margin", "round(gross / revenue * 100, 3)", 0.35),
        ("operating-margin-check", "op_margin", "round(op_income / revenue * 100, 3)", 0.35),
        ("profit-margin-check", "net_margin", "round(net / revenue * 100, 3)", 0.35),
        ("tax-rate-check", "tax_rate", "round(tax / pretax * 100, 3)", 0.35),
    )
)
_VALIDATED = f"""{_STATEMENT}, k AS (SELECT company, q_ord, round(((revenue IS NOT NULL)::INT + (cost IS NOT NULL)::INT + (gross IS NOT NULL)::INT + (opex IS NOT NULL)::INT + (op_income IS NOT NULL)::INT + (pretax IS NOT NULL)::INT + (tax IS NOT NULL)::INT + (net IS NOT NULL)::INT) / 8, 4) AS completeness,
        [x for x in [{_CHECKS}] if x IS NOT NULL] AS told FROM stm),
    kk AS (SELECT company, q_ord, completeness, len(told) AS checks_run, len([x for x in told if x = '']) AS checks_passed, array_to_string([x for x in told if x <> ''], ',') AS issues FROM k),
    kc AS (SELECT *, CASE WHEN checks_run > 0 THEN round(checks_passed / checks_run, 4) ELSE 0.5::DOUBLE END AS consistency FROM kk),
    val AS (SELECT *, least(1.0::DOUBLE, CAST(round(CAST(completeness AS DECIMAL(9, 4)) * 0.55 + CAST(consistency AS DECIMAL(9, 4)) * 0.45, 4) AS DOUBLE)) AS confidence FROM kc)"""
_GRADE = "CASE WHEN {0} >= 0.85 THEN 'high' WHEN {0} >= 0.65 THEN 'medium' ELSE 'low' END AS grade"
_COMPANY = f"""{_VALIDATED}, com AS (SELECT company, count(*) AS n_quarters, CAST(sum(checks_run - checks_passed) AS BIGINT) AS n_issues, count(*) FILTER (checks_run > checks_passed) AS n_mismatch, count(*) FILTER (confidence >= 0.85) AS n_high, round(avg(confidence), 4) AS confidence, max(q_ord) AS latest, arg_max(confidence, q_ord) AS latest_confidence FROM val GROUP BY 1)"""
_TOL = "greatest(0.12::DOUBLE, abs({0}) * 0.03::DOUBLE)"

ORACLE_SQL = {
    "scale_or_residual": f"""WITH {_PARTS}, a AS (SELECT *, sum(value) {_W} / total AS share FROM prt),
        m AS (SELECT *, CASE WHEN share > 1.12 THEN 'scaled-down' WHEN share < 0.94 AND total * (1 - share) > 0.03 THEN 'residual-added' ELSE 'none' END AS mode FROM a WHERE share >= 0.62)
        SELECT company, q_ord, member, round(CASE WHEN mode = 'scaled-down' THEN round(value / share, 3) ELSE value END, 3) AS value, mode FROM m
        UNION ALL SELECT company, q_ord, 'otherrevenue', round(total - sum(value), 3), mode FROM m WHERE mode = 'residual-added' GROUP BY company, q_ord, total, mode""",
    "reconcile_to_total": f"""WITH {_PARTS}, a AS (SELECT * REPLACE (CASE q_ord % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.01::DOUBLE ELSE total END AS total) FROM prt),
        b AS (SELECT *, greatest(0.08::DOUBLE, total * 0.01::DOUBLE) AS tol, sum(value) {_W} AS sm, max(value) {_W} AS mx, count(*) {_W} AS n, row_number() OVER (PARTITION BY company, q_ord ORDER BY member) AS at_ FROM a),
        c AS (SELECT *, mx <= total + tol AND sm <= total + tol AS fits, round(value * total / sm, 3) AS scaled FROM b),
        d AS (SELECT *, coalesce(sum(scaled) OVER (PARTITION BY company, q_ord ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
        e AS (SELECT company, q_ord, member, total, CASE WHEN total IS NULL THEN value WHEN fits THEN round(value, 3) WHEN n = 1 THEN round(least(value, total), 3) WHEN at_ = n THEN round(greatest(total - before, 0), 3) ELSE scaled END AS fitted FROM d WHERE total IS NULL OR total > 0.05)
        SELECT company, q_ord, member, fitted FROM e WHERE total IS NULL OR fitted > 0.02
        UNION ALL SELECT company, q_ord, 'residual', round(total - sm, 3) FROM c WHERE at_ = 1 AND total > 0.05 AND fits AND total - sm > tol""",
    "raw_millions": f"""WITH {_PARTS}, a AS (SELECT * REPLACE (round(CASE WHEN q_ord % 4 = 0 THEN value * 1000 ELSE value END, 3) AS value) FROM prt),
        b AS (SELECT *, max(value) {_W} > revenue * 8 AND sum(value) {_W} > revenue * 8 AND max(value) {_W} > 500 AS slipped FROM a) SELECT company, q_ord, member, CASE WHEN slipped THEN round(value / 1000, 3) ELSE value END AS value, slipped FROM b""",
    "roll_up_children": f"""WITH {_SEG}, f AS (SELECT company, q_ord, round(sum(value), 3) AS value FROM seg WHERE member IN ('NF', 'NO') GROUP BY 1, 2 HAVING count(*) = 2)
        SELECT company, q_ord, member, value FROM seg WHERE member NOT IN ('NF', 'NO') OR (company, q_ord) NOT IN (SELECT company, q_ord FROM f) UNION ALL SELECT company, q_ord, 'N', value FROM f""",
    "from_shares": f"""WITH {_PARTS}, a AS (SELECT *, value / revenue AS share FROM prt), b AS (SELECT *, round(total * share / sum(share) {_W}, 3) AS v FROM a), c AS (SELECT *, round(total - sum(v) {_W}, 3) AS rest, row_number() OVER (PARTITION BY company, q_ord ORDER BY member) AS at_ FROM b)
        SELECT company, q_ord, member, CASE WHEN at_ = 1 AND abs(rest) > 0.004 THEN round(v + rest, 3) ELSE v END AS value FROM c""",
    "q4_outlier_repair": f"""WITH {_SEG}, {_ST}, o AS (SELECT company, q_ord, CASE WHEN q_ord % 4 = 3 AND company % 3 = 0 THEN round(revenue * 4, 3) WHEN q_ord % 4 = 3 AND company % 3 = 1 THEN round(revenue * 3, 3) ELSE revenue END AS revenue FROM st),
        r AS (SELECT company, q_ord, member, CASE WHEN q_ord % 4 = 3 AND company % 3 = 0 THEN round(value * 4, 3) ELSE value END AS value FROM seg WHERE member <> 'NF'),
        h AS (SELECT company, q_ord // 4 AS y, median(revenue) FILTER (q_ord % 4 < 3) AS base, max(revenue) FILTER (q_ord % 4 = 3) AS q4 FROM o GROUP BY 1, 2 HAVING count(*) FILTER (q_ord % 4 < 3 AND revenue > 0) = 3),
        s AS (SELECT company, q_ord, sum(value) AS s FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
        m AS (SELECT company, q_ord // 4 AS y, median(s) FILTER (q_ord % 4 < 3) AS bs, max(s) FILTER (q_ord % 4 = 3) AS q4s, count(*) FILTER (q_ord % 4 = 2) AS q3 FROM s GROUP BY 1, 2 HAVING count(*) FILTER (q_ord % 4 = 3) > 0),
        x AS (SELECT a.company, a.q_ord // 4 AS y, count(*) AS k, median(a.value / b.value) AS mid, max(a.value / b.value) - min(a.value / b.value) AS spread FROM r a JOIN r b ON b.company = a.company AND b.member = a.member AND b.q_ord = a.q_ord - 1 WHERE a.q_ord % 4 = 3 AND a.value > 0.05 AND b.value > 0.05 GROUP BY 1, 2),
        f AS (SELECT h.company, h.y * 4 + 3 AS q_ord, q4s, mid, CASE WHEN q4s / bs <= 1.6 AND q4 / q4s >= 1.8 THEN 'aligned-to-members' WHEN q3 > 0 AND k >= 2 AND mid BETWEEN 2.6 AND 5.4 AND spread <= 1.8 THEN 'annualised' END AS flag FROM h JOIN m USING (company, y) LEFT JOIN x USING (company, y) WHERE q4 / base >= 2.6),
        g AS (SELECT *, CASE WHEN flag = 'annualised' THEN CASE WHEN mid BETWEEN 3.3 AND 4.7 THEN 4.0::DOUBLE ELSE round(mid, 3) END END AS factor FROM f)
        SELECT company, q_ord, CASE flag WHEN 'aligned-to-members' THEN round(q4s, 3) WHEN 'annualised' THEN round(revenue / factor, 3) ELSE revenue END AS revenue, factor, flag FROM o LEFT JOIN g USING (company, q_ord)""",
    "residual_template_impute": f"""WITH {_SPARSE}, s0 AS (SELECT company, q_ord, revenue, round(sum(value), 3) AS sm, list(member) AS ks FROM sps GROUP BY 1, 2, 3 HAVING count(*) >= 2), s AS (SELECT *, sm / revenue AS cov FROM s0 QUALIFY count(*) OVER (PARTITION BY company) >= 3),
        c AS (SELECT company, q_ord, ks, round(revenue - sm, 3) AS res, round(revenue - sm, 3) / revenue AS sh FROM s WHERE cov < 0.72 AND round(revenue - sm, 3) > greatest(0.2, revenue * 0.1) AND round(revenue - sm, 3) / revenue BETWEEN 0.25 AND 0.92),
        t AS (SELECT s.company, s.q_ord, s.ks, s.cov, p.member, p.value / s.sm AS ts, count(*) OVER (PARTITION BY s.company, p.member) AS sup FROM s JOIN sps p USING (company, q_ord) WHERE cov BETWEEN 0.82 AND 1.22),
        j AS (SELECT c.company, c.q_ord, t.member, c.res AS value, t.q_ord AS template, round(abs(c.q_ord - t.q_ord) * 10 + abs(1 - sh / ts) * 6 + abs(cov - 1) * 5, 6) AS score FROM c JOIN t ON t.company = c.company AND list_has_all(t.ks, c.ks) AND len(t.ks) = len(c.ks) + 1 AND NOT list_contains(c.ks, t.member)
            WHERE t.member IN ('N', 'R') AND sup >= 2 AND ts >= 0.12 AND sh / ts BETWEEN 0.45 AND 2.4)
        SELECT company, q_ord, member, value, template FROM j QUALIFY row_number() OVER (PARTITION BY company, q_ord ORDER BY score, template) = 1""",
    "residual_vote": f"""WITH {_SPARSE}, s AS (SELECT company, q_ord, revenue, sum(value) AS sm, list(member) AS ks FROM sps WHERE value > 0.02 GROUP BY 1, 2, 3),
        o AS (SELECT * FROM s WHERE revenue > 0.2 AND revenue - sm > greatest(0.08, revenue * 0.06)),
        v AS (SELECT o.company, o.q_ord, round(o.revenue - o.sm, 3) AS value, p.member, round(sum((0.55::DOUBLE + greatest(0.04::DOUBLE, least(1.2::DOUBLE, p.value / p.revenue))) / abs(p.q_ord - o.q_ord)), 6) AS score, min(abs(p.q_ord - o.q_ord)) AS near
            FROM o JOIN sps p ON p.company = o.company AND p.q_ord <> o.q_ord AND NOT list_contains(o.ks, p.member) AND NOT (list_contains(o.ks, 'A') AND p.member = 'R') WHERE p.value > 0.02 GROUP BY 1, 2, 3, 4),
        r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM v WINDOW w AS (PARTITION BY company, q_ord ORDER BY score DESC, near, member))
        SELECT company, q_ord, member, value, score FROM r WHERE n = 1 AND score >= CASE WHEN second IS NULL AND near <= 24 THEN 0.28 ELSE 0.55 END AND (second IS NULL OR score >= second * 1.18::DOUBLE)""",
    "nearest_quarter_interpolate": f"""WITH {_SEG}, {_ST}, m AS (SELECT * FROM seg WHERE (q_ord + company) % 5 > 1), s AS (SELECT m.company, m.q_ord, st.revenue, round(sum(m.value), 3) AS sm, count(*) AS n FROM m JOIN st USING (company, q_ord) GROUP BY 1, 2, 3),
        e AS (SELECT company, q_ord, revenue FROM st WHERE (company, q_ord) NOT IN (SELECT company, q_ord FROM s) AND revenue > 0.02),
        b AS (SELECT e.*, s.q_ord AS template, s.sm FROM e JOIN s ON s.company = e.company AND abs(s.q_ord - e.q_ord) <= 2 AND sm / s.revenue BETWEEN 0.62 AND 1.18 QUALIFY row_number() OVER (PARTITION BY e.company, e.q_ord ORDER BY round(100 * abs(s.q_ord - e.q_ord) - 4 * n + 20 * abs(sm / s.revenue - 1), 6), s.q_ord) = 1)
        SELECT b.company, b.q_ord, m.member, round(m.value / sm * revenue, 3) AS value, template FROM b JOIN m ON m.company = b.company AND m.q_ord = template""",
    "breakdown_fuse_residual": f"""WITH {_PARTS}, p AS (SELECT * REPLACE (round(revenue * (0.9012345::DOUBLE + q_ord % 3 / 10), 3) AS total) FROM prt),
        c AS (SELECT company, q_ord, 'a' AS source, 120.0::DOUBLE AS priority, member, value, total FROM p WHERE member <> 'RF' UNION ALL SELECT company, q_ord, 'b', 118.0, member, round(value * 1.1234567::DOUBLE, 3), total FROM p WHERE company % 2 = 0),
        s AS (SELECT *, round(priority + 2 * least(count(*) OVER g, 6) + 12 * least(sum(value) OVER g / total, 1), 6) AS score FROM c WINDOW g AS (PARTITION BY company, q_ord, source)),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY company, q_ord, member ORDER BY round(score + least(value, 999) / 1000, 6) DESC, source) = 1),
        n AS (SELECT company, q_ord, total, sum(value) AS sm, count(*) AS n FROM b GROUP BY 1, 2, 3), w AS (SELECT company, q_ord, arg_min(source, (-score, source)) AS source FROM s GROUP BY 1, 2)
        SELECT s.company, s.q_ord, s.member, s.value, s.source FROM s JOIN w USING (company, q_ord, source) JOIN n USING (company, q_ord) WHERE sm > n.total * 1.02::DOUBLE
        UNION ALL SELECT b.company, b.q_ord, b.member, b.value, b.source FROM b JOIN n USING (company, q_ord) WHERE NOT sm > n.total * 1.02::DOUBLE
        UNION ALL SELECT company, q_ord, 'other_opex', round(total - sm, 3), 'derived_residual' FROM n WHERE n >= 2 AND round(total - sm, 3) > greatest(total * 0.015::DOUBLE, 0.05)""",
    "suspicious_breakdown": """WITH l AS (SELECT l_suppkey AS company, CAST(l_linenumber AS BIGINT) AS q_ord, ['rnd', 'fulfillment', 'sales_marketing', 'finance_expense', 'ga', 'other'][l_orderkey % 6 + 1] AS member, l_tax AS value, l_suppkey % 3 * l_linenumber * 5.0::DOUBLE AS total FROM lineitem),
        v AS (SELECT company, q_ord, round(abs(value), 3) AS v, count(*) AS a, count(*) FILTER (value > 0.02) AS n, count(DISTINCT member) FILTER (member <> 'other') AS h, max(total) AS t FROM l GROUP BY 1, 2, 3),
        g AS (SELECT company, q_ord, CAST(sum(a) AS BIGINT) AS n_members, max(v) AS most, sum(n) AS above, max((n, v, h)) FILTER (n > 0) AS modal, count(*) FILTER (n > 0) AS d, sum(v * n) AS sm, max(t) AS t FROM v GROUP BY 1, 2)
        SELECT company, q_ord, n_members, n_members >= 4 AND (most <= 0.02 OR coalesce(above >= 4 AND modal[1] >= 4 AND (modal[3] >= 4 OR CASE WHEN t <= 0 THEN d <= 1 ELSE modal[2] > t * 1.08 + greatest(t * 0.01, 0.12) OR sm > t * 1.35 + greatest(t * 0.03, 0.35) END), false)) AS suspicious FROM g""",
    "statement_validation": f"WITH {_VALIDATED} SELECT *, {_GRADE.format('confidence')} FROM val",
    "company_validation": f"WITH {_COMPANY} SELECT *, {_GRADE.format('confidence')} FROM com",
    "structure_validation": f"""WITH {_COMPANY}, {_SEG}, rv AS (SELECT company, q_ord, CASE WHEN q_ord % 5 = 0 THEN round(revenue * 1.1::DOUBLE, 3) ELSE revenue END AS revenue, opex FROM stm),
        a AS (SELECT company, count(*) AS c, count(*) FILTER (abs(round(s - revenue, 3)) > {_TOL.format('revenue')}) AS m FROM (SELECT company, q_ord, round(sum(abs(value)), 3) AS s FROM seg GROUP BY 1, 2 HAVING count(*) >= 2) JOIN rv USING (company, q_ord) GROUP BY 1),
        b AS (SELECT company, count(*) AS c, count(*) FILTER (abs(round(round(value * CASE WHEN q_ord % 3 = 0 THEN 0.9::DOUBLE ELSE 1 END, 3) - value, 3)) > {_TOL.format('value')}) AS m FROM seg GROUP BY 1),
        d AS (SELECT company, count(*) AS c, count(*) FILTER (round(s - opex, 3) > {_TOL.format('opex')}) AS m FROM (SELECT company, q_ord, round(sum(abs(round(value * 0.102::DOUBLE, 3))), 3) AS s FROM seg WHERE company % 2 = 0 GROUP BY 1, 2 HAVING count(*) >= 2) JOIN rv USING (company, q_ord) GROUP BY 1),
        j AS (SELECT com.company, confidence, coalesce(a.c, 0) AS segment_checks, coalesce(a.m, 0) AS segment_mismatches, coalesce(b.c, 0) AS detail_checks, coalesce(b.m, 0) AS detail_mismatches, coalesce(d.c, 0) AS opex_checks, coalesce(d.m, 0) AS opex_mismatches FROM com LEFT JOIN a USING (company) LEFT JOIN b USING (company) LEFT JOIN d USING (company)),
        sc AS (SELECT *, coalesce(round(list_avg([x for x in [CASE WHEN segment_checks > 0 THEN 1 - segment_mismatches / segment_checks END, CASE WHEN detail_checks > 0 THEN 1 - detail_mismatches / detail_checks END, CASE WHEN opex_checks > 0 THEN 1 - opex_mismatches / opex_checks END] if x IS NOT NULL]), 4), 0.75::DOUBLE) AS structural FROM j),
        z AS (SELECT * EXCLUDE (confidence), CAST(round(CAST(confidence AS DECIMAL(9, 4)) * 0.65 + CAST(structural AS DECIMAL(9, 4)) * 0.35, 4) AS DOUBLE) AS overall FROM sc) SELECT *, {_GRADE.format('overall')} FROM z""",
    "quality_score": f"""WITH {_STATEMENT}, {_SEG}, g AS (SELECT company, q_ord, round(sum(value), 3) AS s FROM seg WHERE member <> 'RF' GROUP BY 1, 2),
        c AS (SELECT stm.*, s, (revenue IS NULL)::INT + (op_income IS NULL)::INT + (net IS NULL)::INT AS mis, CASE WHEN revenue > 0 THEN round(least(coalesce(s, 0) / revenue, 1), 4) END AS a, CASE WHEN cost > 0 THEN round(least(round(revenue * 0.3::DOUBLE, 3) / cost, 1), 4) END AS b, CASE WHEN opex > 0 THEN round(least(round(opex * (q_ord % 10 / 10), 3) / opex, 1), 4) END AS d FROM stm LEFT JOIN g USING (company, q_ord))
        SELECT company, q_ord, CAST(greatest(0, least(100, 100 - mis * 14 - coalesce(floor(round(greatest(0.85::DOUBLE - a, 0) * 24, 6)), 0) - coalesce(floor(round(greatest(0.75::DOUBLE - b, 0) * 18, 6)), 0) - coalesce(floor(round(greatest(0.75::DOUBLE - d, 0) * 18, 6)), 0) + least(company % 9, 6))) AS BIGINT) AS score,
        a AS segment_coverage, CASE WHEN revenue > 0 THEN round(greatest(revenue - s, 0), 3) END AS residual, concat_ws(',', CASE WHEN mis > 0 THEN 'missing-required' END, CASE WHEN a < 0.85 THEN 'segment-coverage-low' END, CASE WHEN b < 0.6 THEN 'cost-coverage-low' END, CASE WHEN d < 0.6 THEN 'opex-coverage-low' END) AS issues FROM c""",
    "degenerate_entry": f"""WITH {_STATEMENT}, v AS (SELECT company, q_ord, [x for x in [round(abs(y), 3) for y in CASE WHEN q_ord % 3 = 0 THEN [revenue, revenue, revenue, revenue, revenue, revenue, revenue, net] ELSE [revenue, cost, gross, opex, op_income, pretax, tax, net] END] if x > 0.02] AS v FROM stm)
        SELECT company, q_ord, len(v) >= 6 AND len(list_distinct(v)) <= 2 AND list_max([len([y for y in v if y = x]) for x in v]) >= 6 AS degenerate FROM v""",
    "renderable_quarters": f"""WITH {_STATEMENT}, r AS (SELECT company, q_ord, gross, cost, op_income, net, tax, CASE WHEN q_ord % 2 = 0 OR company = 3 THEN 0.01::DOUBLE ELSE revenue END AS revenue FROM stm), g AS (SELECT *, revenue > 0.05 AND coalesce(gross, cost, op_income, net, tax) IS NOT NULL AS good FROM r), k AS (SELECT * FROM g QUALIFY good OR NOT max(good) OVER (PARTITION BY company))
        SELECT company, q_ord, revenue, q_ord % 3 <> 0 AND (net IS NOT NULL)::INT + 1 < 2 AND q_ord % 6 = 1 AS low_quality FROM k""",
    "dataset_audit": """WITH r AS (SELECT DISTINCT l_partkey AS company, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS q FROM lineitem), c AS (SELECT company, count(*) AS n, max(q) - min(q) + 1 - count(*) AS gaps, (SELECT max(q) FROM r) - max(q) AS lag FROM r GROUP BY 1)
        SELECT company, 'short-history' AS issue FROM c WHERE n < 20 UNION ALL SELECT company, 'stale' FROM c WHERE lag > 0 UNION ALL SELECT company, 'gaps' FROM c WHERE gaps > 0""",
    "isolated_schemas": f"""WITH {_SPARSE}, s AS (SELECT company, q_ord, string_agg(member, '|' ORDER BY member) AS signature FROM sps GROUP BY 1, 2), n AS (SELECT *, lag(signature) OVER w AS b, lead(signature) OVER w AS neighbours FROM s WINDOW w AS (PARTITION BY company ORDER BY q_ord))
        SELECT company, q_ord, signature, neighbours FROM n WHERE b = neighbours AND signature <> neighbours""",
}

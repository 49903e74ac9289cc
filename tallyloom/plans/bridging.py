"""Queries over bridges and whole quarters, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import bridge, merging
from tallyloom.plans.mending import _SPARSE, _sparse
from tallyloom.plans.queries import _ORD, _Q, _SEG, _ST
from tallyloom.sources.tables import order_statements, read, segments, statements

QUARTER = ["company", "q_ord"]


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose expenses are sound, total costs, or too much, by quarter, and whose income is missing in some."""
    q, c = F.col("q_ord"), F.col("company")
    r3 = lambda x: F.round(x, 3)
    df = statements(spark, sf_dir).withColumn("gross", r3(F.col("revenue") - F.col("cost")))
    opex = F.when(q % 4 == 0, r3(F.col("cost") + F.col("tax"))).when(q % 4 == 1, r3(F.col("tax") * 1.05)).when(q % 4 == 2, F.col("tax")).otherwise(r3(F.col("revenue") * 1.5))
    income = F.when(q % 3 != 0, r3(F.col("gross") - F.col("tax")))
    df = df.withColumn("opex", opex).withColumn("op_income", income).withColumn("opex_sum", F.when(c % 5 == 0, F.col("opex")))
    df = df.withColumn("non_op", F.when(c % 4 != 0, r3(F.col("revenue") * 0.01))).withColumn("net", F.when(c % 3 != 0, r3(F.col("gross") - F.col("tax") * 2)))
    return df.withColumn("pretax", F.when(q % 5 == 0, r3(F.col("gross") - F.col("tax") + F.col("revenue") * 0.01)).when(q % 5 == 1, F.col("revenue")))


def operating_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.operating_stage(_stages(spark, sf_dir)).select(*QUARTER, "total_costs", "reliable", "op_resolved", "opex_resolved")


def pretax_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stages(spark, sf_dir).withColumn("op_resolved", F.col("op_income"))
    return bridge.pretax_stage(df).select(*QUARTER, "pretax_resolved", "residual", "non_op_resolved")


def merge_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and a second source that agrees, lacks the bridge, or has another operating stage."""
    q, r3 = F.col("q_ord"), lambda x: F.round(x, 3)
    null = F.lit(None).cast("double")
    full = statements(spark, sf_dir).withColumn("gross", r3(F.col("revenue") - F.col("cost"))).withColumn("op_income", r3(F.col("gross") - F.col("tax"))).withColumn("opex", F.col("tax"))
    full = full.select(*QUARTER, "revenue", "cost", "gross", F.lit(1.5).alias("sgna"), null.alias("rnd"), null.alias("other_opex"), "opex", "op_income", F.lit(2.5).alias("non_op"), r3(F.col("op_income") + 2.5).alias("pretax"), F.lit(1.0).alias("tax"), r3(F.col("op_income") + 1.5).alias("net"))
    lacks = F.when(q % 4 != 0, F.lit(True))
    own = full.filter("cost > 0.62 * revenue").select(*QUARTER, "revenue", *(F.when(lacks, F.col(c)).alias(c) for c in ("cost", "gross")), F.when(q % 3 == 0, F.lit(9.5)).alias("sgna"), "rnd", "other_opex", F.when(q % 4 == 0, r3(F.col("revenue") + 1)).when(q % 4 == 1, r3(F.col("opex") * 2)).otherwise(F.col("opex")).alias("opex"), "op_income", "non_op", F.when(q % 5 != 0, F.col("pretax")).alias("pretax"), "tax", "net")
    own = own.withColumn("segment_sum", F.when(q % 8 == 0, F.col("revenue") * 2)).withColumn("source", F.when(q % 2 == 0, "sec"))
    return bridge.merge_fallback(own, full.filter("cost < 0.645 * revenue").withColumn("source", F.lit("web")))


def assembled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    names = F.array(*(F.lit(n) for n in ("revenue", "net", "sgna", "sales_marketing", "general_administrative")))
    q = (F.year("ts") * 4 + F.quarter("ts") - 1).cast("long")
    facts = e.select(F.col("user_id").alias("company"), q.alias("q_ord"), F.element_at(names, (i % 5 + 1).cast("int")).alias("field"), F.last_day("ts").alias("end"), F.date_add(F.to_date("ts"), F.floor("value").cast("int")).alias("filed"), i.cast("string").alias("accession"), (i % 2).cast("int").alias("namespace_priority"), (i % 3).cast("int").alias("concept_priority"), "value")
    return bridge.assemble(facts, QUARTER, ["revenue", "net"])


def rule_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as facts with dimensions, under rules of their suppliers' nations."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("company")), "l_suppkey")
    q = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    members = F.when(F.col("l_linenumber") < 3, F.create_map(F.lit("flag"), F.col("l_returnflag"))).otherwise(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")))
    facts = lines.select("company", F.lit("Revenues").alias("concept"), q.alias("start"), F.last_day(F.add_months(q, 2)).alias("end"), F.col("l_quantity").alias("value"), members.alias("members"))
    pick = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), F.array(*(F.lit(m) for m in v)))))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("company"))
    null = F.lit(None).cast("array<string>")
    rules = [("returned", pick(flag=["R"]), null, True), ("shipped", pick(flag=["N", "A"], status=["F"]), null, True), ("plain", pick(flag=["A"]), F.array(F.lit("flag")), False)]
    table = None
    for name, filters, exact, aggregate in rules:
        part = nation.select("company", F.lit(name).alias("member"), filters.alias("filters"), exact.alias("exact"), F.lit(aggregate).alias("aggregate"))
        table = part if table is None else table.unionByName(part)
    return bridge.rule_facts(facts, table, ["company"])


def harmonised_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.harmonise(_sparse(spark, sf_dir))


def fill_recent_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statements(spark, sf_dir).select(*QUARTER, "revenue", F.when(F.col("cost") > 0.63 * F.col("revenue"), F.col("cost")).alias("cost"))
    return bridge.fill_recent(own, order_statements(spark, sf_dir).select(*QUARTER, F.col("revenue").alias("cost")), "cost")


def segment_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and brands as segments, beside some that rules know."""
    known = F.array(*(F.lit(x) for x in ("Upstream", "Banking Markets", "Service Revenue", "Streaming", "Steel operations", "Consumer", "Commercial equipment", "Google Inc.", "EQUITY AFFILIATES income", "DVD", "All other segments", "Financial Products")))
    p = read(spark, sf_dir, "part")
    at = lambda n: F.element_at(known, (F.floor(F.col("p_partkey") / n).cast("int") % 12 + 1).cast("int"))
    names = F.array(at(1), at(12), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit(" ")))
    return p.select("p_partkey", F.array_join(names, "|").alias("names"), bridge.segment_exception(names).alias("exception"), bridge.detail_exception(F.array(F.lit("Leasing"), F.when(F.col("p_size") > 30, F.lit("Regulatory Credits")).otherwise(F.col("p_brand"))), F.when(F.col("p_size") > 10, F.lit("Automotive"))).alias("detail"))


def adjustment_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = statements(spark, sf_dir).select(*QUARTER, "revenue", F.col("tax").alias("op_income"), F.when(F.col("q_ord") % 3 != 0, F.col("tax") * 1.75).otherwise(F.col("tax") * 0.5).alias("net"), (F.col("tax") * (F.col("company") % 4)).alias("gains"), (F.col("company") % 4).alias("n_gains"))
    return bridge.adjustment_strengths(df).select(*QUARTER, "op_ratio", "expansion", "scale", "extreme")


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda x, y, w, h: F.struct(x.alias("left"), y.alias("top"), (x + w).alias("right"), (y + h).alias("bottom"))
    q, k = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    a, b = box(q, k, k * 2, q), box(F.lit(20.0), F.lit(5.0), F.lit(6.0), F.lit(4.0))
    touch, area = bridge.overlap(a, b, 1.5)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", touch.alias("touch"), area.alias("area"))


def rebuild_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose newest order is above their balance are built anew."""
    customers = read(spark, sf_dir, "customer")
    newest = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("_most"))
    checked = customers.join(newest, "c_custkey", "left").select("c_custkey", (F.col("_most") > F.col("c_acctbal") * 100).alias("stale"))
    cached = customers.select("c_custkey", "c_acctbal", F.lit("old").alias("state"))
    return bridge.rebuild_stale(cached, checked, lambda keys: customers.join(keys, "c_custkey", "left_semi").select("c_custkey", (F.col("c_acctbal") * 0 + 1.0).alias("c_acctbal"), F.lit("new").alias("state")), "c_custkey")


def canonical_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators import labels

    aliases = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("company"), F.when(F.col("n_regionkey") == 1, "AF").otherwise("NO").alias("alias"), F.concat(F.lit("own "), "n_name").alias("canonical"))
    return labels.canonical(segments(spark, sf_dir), aliases)


def selected_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators import labels

    n = read(spark, sf_dir, "nation")
    names = F.array(F.lower("n_name"), F.col("n_nationkey").cast("string"))
    return n.filter(labels.selected(names, ["china", "7", "peru", "nobody"])).select("n_nationkey", "n_name")


def matched_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators import labels

    lines = read(spark, sf_dir, "lineitem")
    members = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    return lines.select("l_orderkey", "l_linenumber", labels.member_matches(members, {"flag": ["A", "R"]}).alias("any"), labels.member_matches(members, {"status": ["F"]}, ["status", "flag"]).alias("exact"), labels.member_matches(members, {"status": ["F"]}, ["status"]).alias("alone"))


def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("c_mktsegment"))
    over = F.create_map(F.lit("b"), F.when(F.col("c_acctbal") > 0, F.lit("x")), F.lit("c"), F.col("c_custkey").cast("string"))
    merged = merging.merge_maps(base, over)
    return c.select("c_custkey", *(merged[k].alias(k) for k in "abc"), F.array_join(merging.union_distinct(F.array(F.lit("p"), F.col("c_mktsegment")), F.array(F.col("c_mktsegment"), F.lit("q"), F.lit("p"))), "|").alias("all"))


QUERIES = {f.__name__: f for f in (operating_stage, pretax_stage, merge_fallback, assembled_entries, rule_facts, harmonised_quarters, fill_recent_costs, segment_exceptions, adjustment_strengths, box_overlaps, rebuild_stale, canonical_members, selected_companies, matched_members, merged_maps)}

_STAGES = f"""{_ST}, g AS (SELECT *, round(revenue - cost, 3) AS gross FROM st), stg AS (SELECT *, CASE q_ord % 4 WHEN 0 THEN round(cost + tax, 3) WHEN 1 THEN round(tax * 1.05::DOUBLE, 3) WHEN 2 THEN tax ELSE round(revenue * 1.5::DOUBLE, 3) END AS opex, CASE WHEN q_ord % 3 <> 0 THEN round(gross - tax, 3) END AS op_income,
    CASE WHEN company % 4 <> 0 THEN round(revenue * 0.01::DOUBLE, 3) END AS non_op, CASE WHEN company % 3 <> 0 THEN round(gross - tax * 2, 3) END AS net, CASE q_ord % 5 WHEN 0 THEN round(gross - tax + revenue * 0.01::DOUBLE, 3) WHEN 1 THEN revenue END AS pretax FROM g)"""
_KNOWN = "['Upstream', 'Banking Markets', 'Service Revenue', 'Streaming', 'Steel operations', 'Consumer', 'Commercial equipment', 'Google Inc.', 'EQUITY AFFILIATES income', 'DVD', 'All other segments', 'Financial Products']"
_COUNT = "len(list_filter(l, lambda x: regexp_matches(x, '{0}')))"

ORACLE_SQL = {
    "operating_stage": f"""WITH {_STAGES}, d AS (SELECT *, CASE WHEN company % 5 = 0 THEN opex ELSE 0 END AS listed, greatest(gross - op_income, 0) AS bridge FROM stg),
        e AS (SELECT *, coalesce(listed > 0.05 AND abs(listed - opex) <= greatest(0.35, listed * 0.05), false) AS agrees, abs(opex - CASE WHEN op_income IS NOT NULL THEN bridge END) AS off FROM d),
        t AS (SELECT *, op_income IS NULL AND NOT agrees AND opex > gross + 0.25 AND opex <= revenue + greatest(0.35, revenue * 0.02) AND greatest(opex - cost, 0) <= gross + greatest(0.35, gross * 0.04) AS total_costs,
            CASE WHEN op_income IS NULL THEN NOT (opex > revenue + 0.25 OR opex > gross + 0.25) ELSE NOT opex > gross + 0.25 AND NOT opex > bridge + greatest(0.02, bridge * 0.002) AND (off <= 0.25 OR off / bridge <= 0.08 OR (agrees AND off / bridge <= 0.12)) END AS fits FROM e)
        SELECT company, q_ord, total_costs, fits AND NOT total_costs AS reliable, round(CASE WHEN total_costs THEN revenue - opex ELSE op_income END, 3) + 0.0 AS op_resolved,
            round(CASE WHEN total_costs THEN greatest(opex - cost, 0) WHEN op_income IS NULL THEN CASE WHEN fits THEN opex ELSE 0 END WHEN fits THEN opex ELSE bridge END, 3) + 0.0 AS opex_resolved FROM t""",
    "pretax_stage": f"""WITH {_STAGES}, x AS (SELECT *, net + tax AS a, op_income + non_op AS b FROM stg), p AS (SELECT *, round(CASE WHEN coalesce(abs(pretax - a) <= greatest(0.25, abs(a) * 0.05), false) OR coalesce(abs(pretax - b) <= greatest(0.25, abs(b) * 0.05), false) THEN pretax ELSE coalesce(a, b, pretax) END, 3) + 0.0 AS pt FROM x),
        r AS (SELECT *, pt - op_income AS rest FROM p), k AS (SELECT *, non_op IS NOT NULL AND (rest IS NULL OR abs(non_op - rest) <= 0.25 OR abs(non_op - rest) <= 0.08 * abs(rest)) AS keep FROM r)
        SELECT company, q_ord, pt AS pretax_resolved, NOT keep AND rest IS NOT NULL AS residual, round(CASE WHEN keep THEN non_op ELSE rest END, 3) + 0.0 AS non_op_resolved FROM k""",
    "merge_fallback": f"""WITH {_ST}, f AS (SELECT company, q_ord, revenue, cost, round(revenue - cost, 3) AS gross, tax AS opex, round(round(revenue - cost, 3) - tax, 3) AS op_income FROM st), x AS (SELECT *, round(op_income + 2.5::DOUBLE, 3) AS pretax, round(op_income + 1.5::DOUBLE, 3) AS net, cost > 0.62::DOUBLE * revenue AS own, cost < 0.645::DOUBLE * revenue AS web FROM f),
        y AS (SELECT *, own AND web AND q_ord % 4 = 0 AS whole, own AND web AND (q_ord % 4 = 0 OR (q_ord % 4 = 1 AND opex > greatest(1.2, opex * 0.24))) AS stage, CASE q_ord % 4 WHEN 0 THEN round(revenue + 1, 3) WHEN 1 THEN round(opex * 2, 3) ELSE opex END AS own_opex FROM x WHERE own OR web)
        SELECT company, q_ord, revenue, CASE WHEN web OR q_ord % 4 <> 0 THEN cost END AS cost, CASE WHEN web OR q_ord % 4 <> 0 THEN gross END AS gross, CASE WHEN own AND q_ord % 3 = 0 AND NOT whole AND NOT stage THEN 9.5::DOUBLE WHEN web THEN 1.5::DOUBLE END AS sgna, NULL::DOUBLE AS rnd, NULL::DOUBLE AS other_opex,
            CASE WHEN own AND NOT whole AND NOT stage THEN own_opex ELSE opex END AS opex, op_income, 2.5::DOUBLE AS non_op, CASE WHEN web OR q_ord % 5 <> 0 THEN pretax END AS pretax, 1.0::DOUBLE AS tax, net,
            CASE WHEN stage THEN CASE WHEN q_ord % 2 = 0 THEN 'sec' ELSE 'official' END || '+operating-stage-fallback' WHEN whole THEN 'sec+financial-fallback' WHEN own AND q_ord % 2 = 0 THEN 'sec' WHEN web THEN 'web' END AS source FROM y""",
    "assembled_entries": f"""WITH f AS (SELECT user_id AS company, {_Q.format('ts')} AS q_ord, event_id % 5 AS field, last_day(ts) AS "end", CAST(ts AS DATE) + CAST(floor(value) AS INTEGER) AS filed, event_id % 2 AS ns, event_id % 3 AS cp, value FROM events), g AS (SELECT *, filed - "end" AS gap FROM f),
        o AS (SELECT *, row_number() OVER (PARTITION BY company, q_ord, field ORDER BY gap BETWEEN 0 AND 210 DESC, cp DESC, ns DESC, greatest(gap, 0), filed DESC, value DESC) AS n, row_number() OVER (PARTITION BY company, q_ord ORDER BY gap BETWEEN 0 AND 210 DESC, cp DESC, ns DESC, greatest(gap, 0), filed DESC, value DESC) AS m FROM g),
        w AS (SELECT company, q_ord, max(value) FILTER (n = 1 AND field = 0) AS revenue, max(value) FILTER (n = 1 AND field = 1) AS net, max(value) FILTER (n = 1 AND field = 2) AS s, max(value) FILTER (n = 1 AND field = 3) AS a, max(value) FILTER (n = 1 AND field = 4) AS b, max("end") FILTER (m = 1) AS "end", max(filed) FILTER (m = 1) AS filed FROM o GROUP BY 1, 2)
        SELECT company, q_ord, revenue, net, coalesce(s, a + b, a, b) AS sgna, "end", filed FROM w""",
    "rule_facts": """WITH l AS (SELECT CAST(s_nationkey AS BIGINT) AS company, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start, l_quantity AS value, l_returnflag AS f, CASE WHEN l_linenumber >= 3 THEN l_linestatus END AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
        r AS (SELECT company, 'returned' AS member, start, round(sum(value), 3) AS value, count(*) AS n_facts FROM l WHERE f = 'R' GROUP BY ALL UNION ALL SELECT company, 'shipped', start, round(sum(value), 3), count(*) FROM l WHERE f IN ('N', 'A') AND s = 'F' GROUP BY company, start UNION ALL SELECT company, 'plain', start, round(value, 3), 1 FROM l WHERE f = 'A' AND s IS NULL)
        SELECT company, member, 'Revenues' AS concept, start, CAST(start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", value, n_facts FROM r""",
    "harmonised_quarters": f"""WITH {_SPARSE}, s AS (SELECT *, value / sum(value) OVER w AS share, count(*) OVER w AS n, sum(value) OVER w AS total FROM sps WINDOW w AS (PARTITION BY company, q_ord)), q AS (SELECT company, q_ord, string_agg(member, '|' ORDER BY member) AS names, max(n) AS n, max(share) AS top, max(total) AS total, max(revenue) AS revenue FROM s GROUP BY 1, 2),
        l AS (SELECT *, lag(names) OVER w AS a, lead(names) OVER w AS b, lag(n) OVER w AS an, lag(q_ord) OVER w AS aq, lead(q_ord) OVER w AS bq FROM q WINDOW w AS (PARTITION BY company ORDER BY q_ord)),
        m AS (SELECT *, coalesce(an >= 2 AND a = b AND (n < 2 OR (names <> a AND (top >= 0.82 OR total / revenue NOT BETWEEN 0.7 AND 1.28))), false) AS bad FROM l)
        SELECT s.company, s.q_ord, member, value, false AS synthetic FROM s JOIN m USING (company, q_ord) WHERE NOT bad
        UNION ALL SELECT m.company, m.q_ord, x.member, round(m.revenue * (x.share + y.share) / 2, 3), true FROM m JOIN s x ON x.company = m.company AND x.q_ord = m.aq JOIN s y ON y.company = m.company AND y.q_ord = m.bq AND y.member = x.member WHERE bad""",
    "fill_recent_costs": f"""WITH {_ST}, {_ORD}, o AS (SELECT company, q_ord, revenue, CASE WHEN cost > 0.63::DOUBLE * revenue THEN cost END AS cost FROM st), n AS (SELECT *, row_number() OVER (PARTITION BY company, cost IS NULL ORDER BY q_ord DESC) AS n FROM o)
        SELECT n.company, n.q_ord, n.revenue, CASE WHEN n.cost IS NULL AND n <= 12 THEN ord.revenue ELSE n.cost END AS cost, n.cost IS NULL AND n <= 12 AND ord.revenue IS NOT NULL AS filled FROM n LEFT JOIN ord USING (company, q_ord)""",
    "segment_exceptions": f"""WITH p AS (SELECT *, [{_KNOWN}[p_partkey % 12 + 1], {_KNOWN}[p_partkey // 12 % 12 + 1], CASE WHEN p_size > 25 THEN p_type ELSE ' ' END] AS names FROM part), k AS (SELECT *, list_filter(list_transform(names, lambda x: lower(trim(x))), lambda x: x <> '') AS l FROM p), c AS (SELECT *, len(l) AS n FROM k)
        SELECT p_partkey, array_to_string(names, '|') AS names, CASE WHEN n < 2 THEN NULL
            WHEN {_COUNT.format(r'\b(banking|markets|wealth|investment|consumer|commercial|community|asset)\b')} >= greatest(3, n - 1) THEN 'business-line-revenue-disclosure'
            WHEN {_COUNT.format(r'\b(revenue|revenues|service|services|transaction|processing|assessment)\b')} = n THEN 'partial-revenue-component-disclosure'
            WHEN n = 2 AND {_COUNT.format(r'\b(streaming|dvd)\b')} = n AND list_contains(l, 'streaming') THEN 'legacy-business-model-disclosure'
            WHEN {_COUNT.format(r'\b(operations?)\b')} = n THEN 'partial-operation-model-disclosure'
            WHEN {_COUNT.format(r'\b(equipment)\b')} = n THEN 'capital-bucket-disclosure'
            WHEN {_COUNT.format(r'\b(upstream|downstream|all other segments)\b')} = n THEN 'partial-energy-business-disclosure'
            WHEN {_COUNT.format(r'\b(revenue|income|equity affiliates|other revenue)\b')} >= 2 AND (contains(array_to_string(l, '|'), 'equity affiliates') OR contains(array_to_string(l, '|'), 'other revenue')) THEN 'statement-component-disclosure'
            WHEN n = 2 AND {_COUNT.format(r'(google inc\.?|all other segments)')} = n AND contains(array_to_string(l, '|'), 'google inc.') THEN 'legacy-core-segment-disclosure'
            WHEN {_COUNT.format(r'\b(energy products|chemical products|specialty products|upstream)\b')} = n THEN 'partial-energy-product-disclosure'
            WHEN n = 2 AND {_COUNT.format(r'\b(innovative medicine|med tech|medical devices|consumer)\b')} = n AND list_contains(l, 'consumer') THEN 'partial-healthcare-business-disclosure'
            WHEN n = 2 AND {_COUNT.format(r'\b(machinery energy transportation|financial products)\b')} = n AND list_contains(l, 'financial products') THEN 'industrial-plus-financial-products-disclosure' END AS exception,
            CASE WHEN p_size > 30 THEN 'partial-auto-component-disclosure' END AS detail FROM c""",
    "adjustment_strengths": f"""WITH {_ST}, a AS (SELECT company, q_ord, revenue, tax AS op, CASE WHEN q_ord % 3 <> 0 THEN tax * 1.75::DOUBLE ELSE tax * 0.5::DOUBLE END AS net, tax * (company % 4) AS gains, company % 4 AS n FROM st),
        b AS (SELECT *, CASE WHEN gains > 0.02 AND op > 0.02 THEN gains / op ELSE 0 END AS r, CASE WHEN gains > 0.02 AND net > 0.02 THEN greatest(net - op, 0) / net ELSE 0 END AS m FROM a)
        SELECT company, q_ord, round(r, 6) AS op_ratio, round(m, 6) AS expansion, round(CASE WHEN n > 0 THEN least(r * 0.58 + m * 0.74 + gains / revenue * 0.38, 1) ELSE 0 END, 6) AS scale, round(CASE WHEN n > 0 THEN least(greatest(r - 1.1, 0) / 1.7 + greatest(m - 0.45, 0) * 0.6, 1) ELSE 0 END, 6) AS extreme FROM b""",
    "box_overlaps": """SELECT l_orderkey, l_linenumber, NOT (l_quantity + 2 * l_linenumber + 1.5 <= 20 OR 27.5 <= l_quantity OR l_linenumber + l_quantity + 1.5 <= 5 OR 10.5 <= l_linenumber) AS touch,
        greatest(least(l_quantity + 2 * l_linenumber, 27.5::DOUBLE) - greatest(l_quantity, 18.5::DOUBLE), 0) * greatest(least(l_linenumber + l_quantity, 10.5::DOUBLE) - greatest(l_linenumber, 3.5::DOUBLE), 0) AS area FROM lineitem""",
    "rebuild_stale": """WITH m AS (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN most > c_acctbal * 100 THEN 1.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN most > c_acctbal * 100 THEN 'new' ELSE 'old' END AS state FROM customer LEFT JOIN m ON o_custkey = c_custkey""",
    "canonical_members": f"WITH {_SEG} SELECT company, q_ord, CASE WHEN member = CASE WHEN n_regionkey = 1 THEN 'AF' ELSE 'NO' END THEN 'own ' || n_name ELSE member END AS member, value FROM seg JOIN nation ON n_nationkey = company",
    "selected_companies": "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('china', 'peru') OR n_nationkey = 7",
    "matched_members": """SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'R') AS "any", l_linestatus = 'F' AS exact, false AS alone FROM lineitem""",
    "merged_maps": """SELECT c_custkey, '1' AS a, CASE WHEN c_acctbal > 0 THEN 'x' ELSE c_mktsegment END AS b, CAST(c_custkey AS VARCHAR) AS c, 'p|' || c_mktsegment || '|q' AS "all" FROM customer""",
}

"""Queries over details, groups and observations, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import detail
from tallyloom.plans.queries import _SEG, _ST
from tallyloom.sources.tables import read, segments, statements
from tallyloom.streaming import events

QUARTER = ["company", "q_ord"]


def label_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    names = F.when(F.col("c_mktsegment") == "BUILDING", "Reportable Segment Aggregation, before other operating").when(F.col("c_mktsegment") == "MACHINERY", "All Other Segments").when(F.col("c_mktsegment") == "FURNITURE", "Corporate & other").when(F.col("c_mktsegment") == "HOUSEHOLD", "Corporate and all other").otherwise(F.col("c_name"))
    return c.select("c_custkey", detail.label_penalty(names).cast("long").alias("penalty"))


def expanded_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of which RF is called products and NF an aggregate, with two or three details each that sum to most or half of them."""
    named = F.when(F.col("member") == "RF", "Products").when(F.col("member") == "NF", "Business segments").otherwise(F.col("member"))
    rows = segments(spark, sf_dir).withColumn("member", named)
    q = F.col("q_ord") % 3
    share = F.when(q == 0, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.125))).when(q == 1, F.array(F.lit(0.5), F.lit(0.375))).otherwise(F.array(F.lit(0.25), F.lit(0.25)))
    parts = rows.filter("member IN ('Products', 'Business segments')").select(*QUARTER, F.col("member").alias("target"), "value", F.posexplode(share).alias("i", "s"))
    details = parts.select(*QUARTER, "target", F.concat("target", F.lit(" x"), F.col("i").cast("string")).alias("member"), (F.col("value") * F.col("s")).alias("value"))
    details = details.withColumn("member", F.regexp_replace("member", "Business segments", "detail"))
    return detail.expand_details(rows, details, QUARTER)


def regrouped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("style", F.when(F.col("company") % 2 == 0, "flags")).withColumn("yoy", F.when(F.col("member") != "AF", (F.col("q_ord") % 7).cast("double") + 0.25))
    groups = spark.createDataFrame([("flags", "AF", "closed"), ("flags", "RF", "closed"), ("other", "NO", "none")], "style string, member string, parent string")
    return detail.regroup(rows, groups, QUARTER, "yoy")


def nearest_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as anchors, their lines as percentages around them."""
    places = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    seen = places.select(F.col("l_orderkey").alias("page"), F.concat(F.col("q").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 != 0, "%").otherwise(" pts")).alias("text"), (0.5 + (F.col("q") - 25) / 500).alias("x"), (0.5 - F.col("l_linenumber") / 64).alias("y"))
    anchors = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit("a").alias("anchor"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    return detail.nearest_below(anchors, seen)


def backfilled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "array<struct<member:string,value:double>>"
    dataset = statements(spark, sf_dir).filter("tax > 0.0395 * revenue").select(*QUARTER, "revenue", F.array().cast(kind).alias("rows"))
    history = segments(spark, sf_dir).filter("value > 0.2 * 100000").groupBy(*QUARTER).agg(F.array_sort(F.collect_list(F.struct("member", "value"))).alias("rows"))
    return detail.backfill(dataset, history).select(*QUARTER, "revenue", F.array_join(F.transform("rows", lambda r: r["member"]), "|").alias("members"))


def comparable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are named by flag and status while RF is there with AF, and by status alone where NO is."""
    rows = segments(spark, sf_dir).withColumn("filed", F.concat(F.col("q_ord").cast("string"), F.lit("-"), F.col("member")))
    lists = lambda *names: F.array(*(F.lit(n) for n in names))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("company"))
    phase = lambda name, i, some, every: nation.select("company", F.lit(name).alias("phase"), F.lit(i).alias("phase_order"), some.alias("any_of"), every.alias("all_of"))
    phases = phase("new", 0, lists("NO"), lists("NF")).unionByName(phase("open", 1, lists("NO", "AO"), lists("NO"))).unionByName(phase("old", 2, lists("AF", "RF"), lists("RF")))
    pairs = [("new", "NO", "open"), ("new", "NF", "closed"), ("new", "RF", "closed"), ("open", "NO", "open"), ("old", "AF", "closed"), ("old", "RF", "closed")]
    mapping = nation.select("company", F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(m).alias("member"), F.lit(s).alias("segment")) for p, m, s in pairs))).alias("r")).select("company", "r.*")
    return detail.comparable(rows, phases, mapping, QUARTER)


def resolved_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).groupBy(*QUARTER).agg(F.collect_set("member").alias("members")).withColumn("style", F.when(F.col("q_ord") % 5 == 0, "own").when(F.col("q_ord") % 5 == 1, " "))
    nation = read(spark, sf_dir, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").cast("long").alias("company"))
    lists = lambda *names: F.array(*(F.lit(n) for n in names))
    rules = nation.select("company", F.lit(0).alias("rule_order"), lists("NO", "RF").alias("needs"), F.lit("both").alias("rule_style")).unionByName(nation.select("company", F.lit(1).alias("rule_order"), lists("RF").alias("needs"), F.lit("flags").alias("rule_style")))
    return detail.styled(rows, rules)


def best_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    pages = p.select(F.col("p_brand"), F.col("p_partkey").alias("page"), F.concat("p_type", F.lit("\n "), "p_name").alias("text"), (F.col("p_size") > 25).alias("from_text"))
    return detail.best_page(pages, {"promo": 5, r"\bring\b": 2, "red": 1, r"(large|small) \w+ gear": 2}, "p_brand")


def translated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.initcap("c_mktsegment"), F.when(F.col("c_acctbal") > 0, " and Other").otherwise(" ")).alias("label"))
    dictionary = spark.createDataFrame([(" BUILDING", "建筑"), ("machinery and other", "机械及其他"), ("Building", "楼宇")], "label string, translation string")
    return detail.translated(names, dictionary, {"and other": "及其他", "household ": "家庭"})


def joined_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    tail = F.when(F.col("p_size") > 25, "\n | 3 | 4,5").otherwise("\n| x | 4")
    return p.select("p_partkey", F.array_join(text.joined_cells(F.concat(F.lit("|1|2\n"), F.col("p_brand"), F.lit(" | 1"), tail, F.lit("\n\nend"))), "#").alias("lines"))


def company_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{events.shared_folder(spark)}/partitions/{uuid.uuid4().hex}"
    detail.Partitions.write(statements(spark, sf_dir), base)
    store = detail.Partitions(spark, base)
    both = store.company(12).unionByName(store.company(3)).unionByName(store.company(12))
    return both.select(F.col("company").cast("long").alias("company"), "q_ord", "revenue")


QUERIES = {f.__name__: f for f in (label_penalties, expanded_details, regrouped_members, nearest_percent, backfilled_segments, comparable_segments, resolved_styles, best_pages, translated_labels, joined_cells, company_partition)}

ORACLE_SQL = {
    "label_penalties": "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 530 WHEN 'MACHINERY' THEN 32 WHEN 'HOUSEHOLD' THEN 18 WHEN 'FURNITURE' THEN 18 ELSE 0 END AS BIGINT) AS penalty FROM customer",
    "expanded_details": f"""WITH {_SEG}, r AS (SELECT company, q_ord, CASE member WHEN 'RF' THEN 'Products' WHEN 'NF' THEN 'Business segments' ELSE member END AS member, value, count(*) OVER w AS n, sum(value) OVER w AS total FROM seg WINDOW w AS (PARTITION BY company, q_ord)),
        k AS (SELECT *, CASE q_ord % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS parts FROM r), f AS (SELECT *, parts > 0 AND (member = 'Products' OR (member = 'Business segments' AND parts >= 3 AND value / total >= 0.28)) AND value > 0.02 AS fits FROM k),
        b AS (SELECT *, fits AND member = 'Business segments' AND n - 1 + parts <= 7 AS first FROM f), c AS (SELECT *, n + CASE WHEN max(first) OVER (PARTITION BY company, q_ord) THEN parts - 1 ELSE 0 END AS n2 FROM b), t AS (SELECT *, first OR (fits AND member = 'Products' AND n2 - 1 + parts <= 7) AS taken FROM c)
        SELECT company, q_ord, member, value, NULL AS target FROM t WHERE NOT taken
        UNION ALL SELECT company, q_ord, CASE WHEN member = 'Products' THEN 'Products x' ELSE 'detail x' END || i, value * CASE q_ord % 3 WHEN 0 THEN [0.5::DOUBLE, 0.25::DOUBLE, 0.125::DOUBLE][i + 1] ELSE [0.5::DOUBLE, 0.375::DOUBLE][i + 1] END, member FROM (SELECT *, unnest(range(parts)) AS i FROM t WHERE taken)""",
    "regrouped_members": f"""WITH {_SEG}, g AS (SELECT company, q_ord, CASE WHEN company % 2 = 0 AND member IN ('AF', 'RF') THEN 'closed' ELSE member END AS member, value, CASE WHEN member <> 'AF' THEN q_ord % 7 + 0.25::DOUBLE END AS yoy FROM seg)
        SELECT company, q_ord, member, round(sum(value), 3) AS value, round(sum(value * yoy) / sum(value), 1) + 0.0 AS yoy, count(*) AS n_members FROM g GROUP BY 1, 2, 3""",
    "nearest_percent": """WITH p AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey AS page, CAST(q AS INTEGER) || '%' AS text, 0.5 + (q - 25) / 500 AS x, 0.5 - l_linenumber / 64.0::DOUBLE AS y FROM p WHERE l_linenumber % 3 <> 0),
        b AS (SELECT page, arg_min(text, (round((0.5 - y) + 0.6::DOUBLE * abs(0.5 - x), 9), text)) AS text FROM s WHERE abs(0.5 - x) <= 0.045 AND 0.5 - y > 0 AND 0.5 - y <= 0.06 GROUP BY 1) SELECT o_orderkey AS page, 'a' AS anchor, text FROM orders LEFT JOIN b ON page = o_orderkey""",
    "backfilled_segments": f"""WITH {_ST}, {_SEG}, h AS (SELECT company, q_ord, string_agg(member, '|' ORDER BY member) AS members FROM seg WHERE value > 20000 GROUP BY 1, 2) SELECT st.company, st.q_ord, revenue, coalesce(members, '') AS members FROM st LEFT JOIN h USING (company, q_ord) WHERE tax > 0.0395::DOUBLE * revenue""",
    "comparable_segments": f"""WITH {_SEG}, p AS (SELECT company, q_ord, CASE WHEN bool_or(member = 'NO') AND bool_or(member = 'NF') THEN 'new' WHEN bool_or(member = 'NO') THEN 'open' WHEN bool_or(member = 'RF') THEN 'old' END AS phase FROM seg GROUP BY 1, 2),
        m AS (SELECT seg.*, phase, CASE WHEN phase IN ('new', 'open') AND member = 'NO' THEN 'open' WHEN phase = 'new' AND member IN ('NF', 'RF') OR phase = 'old' AND member IN ('AF', 'RF') THEN 'closed' END AS segment FROM seg JOIN p USING (company, q_ord))
        SELECT company, q_ord, phase, segment, round(sum(value), 3) AS value, max(q_ord || '-' || member) AS filed FROM m WHERE segment IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "resolved_styles": f"""WITH {_SEG}, m AS (SELECT company, q_ord, bool_or(member = 'NO') AS a, bool_or(member = 'RF') AS b FROM seg GROUP BY 1, 2)
        SELECT company, q_ord, CASE WHEN q_ord % 5 = 0 THEN 'own' WHEN company < 15 AND a AND b THEN 'both' WHEN company < 15 AND b THEN 'flags' END AS style FROM m""",
    "best_pages": r"""WITH s AS (SELECT p_brand, p_partkey AS page, p_size > 25 AS t, lower(p_type || ' ' || p_name) AS x FROM part), c AS (SELECT *, CASE WHEN x LIKE '%promo%' THEN 5 ELSE 0 END + CASE WHEN regexp_matches(x, '\bring\b') THEN 2 ELSE 0 END + CASE WHEN x LIKE '%red%' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '(large|small) \w+ gear') THEN 2 ELSE 0 END AS score FROM s)
        SELECT p_brand, page, CAST(score AS BIGINT) AS score FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, t DESC, page) = 1""",
    "translated_labels": """WITH n AS (SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_acctbal > 0 THEN ' and Other' ELSE ' ' END AS label FROM customer)
        SELECT c_custkey, label, CASE lower(trim(label)) WHEN 'building' THEN '建筑' WHEN 'machinery and other' THEN '机械及其他' ELSE replace(replace(label, 'and Other', '及其他'), 'Household ', '家庭') END AS translation FROM n""",
    "joined_cells": "SELECT p_partkey, '|1|2#' || p_brand || ' | 1' || CASE WHEN p_size > 25 THEN ' | 3 | 4,5' ELSE '#| x | 4' END || '#end' AS lines FROM part",
    "company_partition": f"WITH {_ST} SELECT company, q_ord, revenue FROM st WHERE company IN (3, 12) UNION ALL SELECT company, q_ord, revenue FROM st WHERE company = 12",
}

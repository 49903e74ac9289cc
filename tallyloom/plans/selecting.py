"""Queries that choose among facts, axes, rows and sources, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import checks, merging, repairs, selection
from tallyloom.plans.queries import _ORD, _Q, _SEG, _ST
from tallyloom.sources.tables import order_statements, quarter_of, read, segments, statements

QUARTER = ["company", "q_ord"]


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: a month's, filed some days after it or before."""
    e, c = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.col("user_id").alias("company"), F.col("event_type").alias("concept"), F.to_date(F.date_trunc("quarter", "ts")).alias("start"), F.last_day("ts").alias("end"), F.date_add(F.to_date("ts"), F.floor("value").cast("int")).alias("filed"), c.cast("string").alias("accession"), (c % 2).cast("int").alias("namespace_priority"), (c % 3).cast("int").alias("concept_priority"), F.when(c % 5 == 0, "10-K").when(c % 5 == 1, "8-K").otherwise("10-q").alias("form"), "value")


def best_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_facts(_filed(spark, sf_dir), ["company", "concept", "start", "end"]).select("company", "concept", "start", "end", "accession", "value")


def best_segment_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_segment_facts(_filed(spark, sf_dir), ["company", "concept", "start", "end"]).select("company", "concept", "start", "end", "form", "filed", "value")


def best_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines by product, by brand and by the buyer's nation."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("o_orderkey"), quarter_of("l_shipdate").alias("end"))
    parts = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    buyers = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    by = lambda df, axis, priority, member: df.select("company", F.lit(axis).alias("axis"), F.lit(priority).alias("axis_priority"), F.col(member).alias("member"), "end", F.lit(2).alias("concept_priority"))
    facts = by(parts, "ProductOrServiceAxis", 80, "p_type").unionByName(by(parts, "StatementBusinessSegmentsAxis", 70, "p_brand")).unionByName(by(lines.join(buyers, "o_orderkey"), "StatementGeographicalAxis", 100, "n_name"))
    return selection.best_axis(facts, ["company"])


def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, order priorities and line numbers as sources that write in turn."""
    own = segments(spark, sf_dir).groupBy(*QUARTER).agg(F.count(F.lit(1)).alias("n_rows"))
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("company")), "o_custkey")
    by_order = orders.filter("o_orderstatus <> 'P'").groupBy("company", quarter_of("o_orderdate").alias("q_ord")).agg(F.countDistinct("o_orderpriority").alias("n_rows"))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("company")), "l_suppkey")
    by_line = lines.filter("l_quantity >= 45").groupBy("company", quarter_of("l_shipdate").alias("q_ord")).agg(F.countDistinct("l_linenumber").alias("n_rows"))
    offer = lambda df, name, order, kind: df.select(*QUARTER, F.lit(name).alias("source"), F.lit(order).alias("source_order"), F.lit(kind).alias("kind"), "n_rows")
    return selection.last_writer(offer(own, "members", 0, "segments").unionByName(offer(by_order, "orders", 1, "structure")).unionByName(offer(by_line, "lines", 2, "segments")), QUARTER)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "event_id", F.to_date(F.date_trunc("month", "ts")).alias("filed"), "value", F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"), F.when(F.col("value") > 20, F.concat(F.lit("z"), F.col("event_id").cast("string"))).alias("name_zh"))


def merge_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.merge_newest(_told(spark, sf_dir), ["user_id", "event_type"], "event_id", "name_zh")


def merge_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.merge_canonical(_told(spark, sf_dir), ["user_id", "event_type"], "event_id").drop("name_zh")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by member and orders by priority as sources of a quarter's rows."""
    revenue = statements(spark, sf_dir).select(*QUARTER, "revenue")
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("company")), "o_custkey")
    by_priority = orders.groupBy("company", quarter_of("o_orderdate").alias("q_ord"), F.col("o_orderpriority").alias("member")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(15,2)")), 3).cast("double").alias("value"))
    rows = segments(spark, sf_dir).select(*QUARTER, "member", "value", F.lit("lines").alias("source"), F.lit(1).alias("source_order"), F.lit(600).alias("lag_days")).unionByName(by_priority.select(*QUARTER, "member", "value", F.lit("orders").alias("source"), F.lit(0).alias("source_order"), F.lit(40).alias("lag_days")))
    return rows.join(revenue, QUARTER)


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_candidate(_candidates(spark, sf_dir), QUARTER)


def best_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select(*QUARTER, F.col("source").alias("candidate"), F.col("source_order").alias("candidate_order"), "member", "value", F.col("revenue").alias("total"))
    return selection.best_expenses(rows, QUARTER)


def _echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four expenses that repeat the tax (or sum up, by quarter), under names by company."""
    q, c = F.col("q_ord"), F.col("company")
    names = F.when(c % 3 == 0, F.array(*(F.lit(n) for n in ("rnd", "general_administrative", "Fulfillment", "sales_marketing")))).otherwise(F.array(*(F.lit(n) for n in ("a", "b", "c", "d"))))
    rows = statements(spark, sf_dir).select(*QUARTER, "revenue", "cost", "tax", F.posexplode(names).alias("i", "member"))
    return rows.select(*QUARTER, "member", F.when(q % 2 == 0, F.col("tax")).otherwise(F.round(F.col("tax") * (1 + F.col("i")), 2)).alias("value"), F.when(q % 4 == 2, F.col("tax") * 5).otherwise(F.col("tax") * 2).alias("total"), F.when(q % 8 < 4, F.array("revenue", "tax")).otherwise(F.array("revenue", "cost")).alias("statement"))


def suspicious_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.suspicious_expenses(_echoes(spark, sf_dir), QUARTER)


def opex_overflow_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).join(statements(spark, sf_dir).select(*QUARTER, "revenue", "cost"), QUARTER)
    opex = F.when(F.col("q_ord") % 2 == 0, F.col("revenue") / 1.1).otherwise(F.col("cost"))
    return selection.skipped_overflows(rows.select(*QUARTER, "member", "value", opex.alias("opex")), QUARTER, "^(af|nf|no|rf|ro)$")


def validation_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("eligible", F.lit(True)).withColumn("notes", F.when(F.col("member") == "RF", F.array(F.lit("half-year"))).otherwise(F.array(F.lit("checked"))))
    notes = statements(spark, sf_dir).filter("tax > 0.04 * revenue").select(*QUARTER, selection.reporting_cycle(F.col("q_ord")).alias("note"))
    return selection.mark_ineligible(rows, notes, QUARTER).withColumn("notes", F.array_join("notes", "|"))


def policy_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = statements(spark, sf_dir).select(*QUARTER, (F.col("revenue") > F.col("cost") * 1.585).alias("has_revenue"), (F.col("tax") > 0.0395 * F.col("revenue")).alias("has_expense"))
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    cycles = F.when(r == 0, F.array(F.lit("annual"))).when(r == 1, F.array(F.lit("half-year"), F.lit("annual"))).when(r == 2, F.array(F.lit("monthly")))
    policies = read(spark, sf_dir, "nation").select(n.cast("long").alias("company"), (r < 4).alias("classified_only"), cycles.alias("cycles"), (n % 3 != 0).alias("need_revenue"), (n % 2 == 0).alias("need_expense"))
    return selection.by_policy(quarters, policies)


def epoch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AF and RF belong to an older naming than NO; NF to both."""
    rows = segments(spark, sf_dir)
    first = rows.groupBy("company").agg(F.min("q_ord").alias("_first"))
    names = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.lit(e).alias("epoch"), F.lit(d).alias("d")) for m, e, d in (("AF", "old", 0), ("RF", "old", 0), ("NF", "old", 0), ("NF", "new", 14), ("NO", "new", 14)))))
    epochs = first.select("company", "_first", names.alias("e")).select("company", "e.member", "e.epoch", (F.col("_first") + F.col("e.d")).alias("first_q"))
    return selection.one_epoch(rows, epochs)


def shares_to_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).join(statements(spark, sf_dir).select(*QUARTER, "revenue"), QUARTER)
    share = F.round(F.col("value") / F.col("revenue") * 100, 2)
    c = F.col("company")
    null = F.lit(None).cast("double")
    told = rows.select(*QUARTER, "member", F.when(c % 4 == 1, "share").alias("mode"), F.when(c % 4 == 1, share).alias("mix_pct"), F.when(c % 4 == 2, F.floor(F.col("value") / 2).cast("double")).otherwise(null).alias("flow"), F.when(c % 4 == 0, share).otherwise(F.col("value")).alias("value"), "revenue")
    return selection.shares_to_values(told, QUARTER).select(*QUARTER, "member", "value")


def scale_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).join(order_statements(spark, sf_dir).select(*QUARTER, "revenue"), QUARTER)
    return selection.scale_flows(rows.withColumnRenamed("value", "flow"), QUARTER).drop("revenue")


def accepted_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).join(order_statements(spark, sf_dir).select(*QUARTER, F.col("revenue").alias("expected")), QUARTER, "left")
    return selection.accepted(rows, QUARTER, 0.5, 2.0)


def ordered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("RF", 1), ("NO", 2)], "member string, place long")
    return selection.ordered(segments(spark, sf_dir), QUARTER, own)


def loose_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.make_date(F.floor(F.col("q_ord") / 4).cast("int"), (F.col("q_ord") % 4 * 3 + 3).cast("int"), F.lit(28))
    own = statements(spark, sf_dir).select(*QUARTER, day.alias("period_end"), F.when(F.col("tax") > 0.0395 * F.col("revenue"), F.col("revenue")).alias("revenue"), F.col("revenue").alias("_r"))
    entries = own.select((F.col("company") * 100000 + F.col("q_ord")).alias("entry"), "company", "period_end", F.when(F.col("q_ord") % 3 == 0, F.col("_r") + 0.001).when(F.col("q_ord") % 3 == 1, F.col("_r") + 5).alias("revenue"), F.when(F.col("q_ord") % 4 == 0, F.concat(F.floor(F.col("q_ord") / 4).cast("string"), F.lit("Q1"))).when(F.col("q_ord") % 4 == 1, "Q2").alias("quarter"))
    return merging.loose_quarter(entries, own.drop("_r"))


def merge_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("accession"), "event_type", "value")
    fresh = e.filter("value > 10").withColumn("event_type", F.when(F.col("value") < 30, F.col("event_type")))
    return merging.merge_filings(fresh, e.filter("value < 40").withColumn("value", F.lit(1.5)), "accession")


def preserve_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).groupBy(*QUARTER).agg(F.array_sort(F.collect_list("member")).alias("members"))
    fresh = statements(spark, sf_dir).filter("tax > 0.039 * revenue").join(rows, QUARTER).select(*QUARTER, "revenue", F.when(F.col("company") % 3 == 0, F.array().cast("array<string>")).when(F.col("company") % 3 == 1, F.col("members")).alias("members"))
    cached = statements(spark, sf_dir).select(*QUARTER, (F.col("revenue") * 0 + 1.0).alias("revenue"), F.array(F.lit("old")).alias("members"))
    return merging.preserve_lists(fresh, cached, ["members"]).withColumn("members", F.array_join("members", "|"))


def null_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("q_ord") % 2 == 0, F.array(F.lit("aligned"))).otherwise(F.array().cast("array<string>"))
    rows = statements(spark, sf_dir).join(order_statements(spark, sf_dir).select(*QUARTER, F.col("revenue").alias("gross")), QUARTER).withColumn("flags", flags)
    return merging.null_bridge(rows, ["cost", "gross"], ["cost", "gross", "tax"], "aligned", "cleared").withColumn("flags", F.array_join("flags", "|"))


def attach_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority attached to the statements that there are, or to new ones."""
    by = _candidates(spark, sf_dir).filter("source = 'orders'").groupBy(*QUARTER).agg(F.array_sort(F.collect_list(F.struct("member", "value"))).alias("rows"))
    entries = statements(spark, sf_dir).filter("tax > 0.0395 * revenue").select(*QUARTER, "revenue", F.array().cast("array<struct<member:string,value:double>>").alias("rows"))
    shown = by.withColumn("display_revenue", F.when(F.col("q_ord") % 2 == 0, F.lit(1.25)))
    return merging.attach(entries, shown).select(*QUARTER, "revenue", F.size(F.coalesce("rows", F.array())).cast("long").alias("n_rows"), "source")


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' queries (a nation's name, its beginning, or it with the segment) against names of nations and regions."""
    nations = read(spark, sf_dir, "nation")
    aliases = nations.select(F.lower("n_name").alias("alias"), F.col("n_nationkey").cast("long").alias("company"), F.lit(0).alias("source_order"), F.col("n_nationkey").alias("position"))
    second = nations.select(F.lower(F.substring("n_name", 1, 2)).alias("alias"), F.col("n_nationkey").cast("long").alias("company"), F.lit(1).alias("source_order"), F.col("n_nationkey").alias("position"))
    segment, name = F.lower("c_mktsegment"), F.lower("n_name")
    query = F.when(segment == "building", name).when(segment == "machinery", F.substring(name, 1, 4)).when(segment == "furniture", F.substring(name, 2, 3)).otherwise(F.concat(segment, name))
    asked = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", query.alias("query"))
    return merging.by_alias(asked, aliases.unionByName(second)).select("c_custkey", "company", "exact")


def ticker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickers = read(spark, sf_dir, "supplier").select(F.concat(F.lit(" s."), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_suppkey").alias("number"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("S-"), F.col("c_custkey").cast("string")).alias("ticker"))
    return merging.lookup_number(rows, tickers).select("c_custkey", "number")


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    body = F.concat(F.lit("Net\n"), F.col("p_name"), F.lit("  of\r\n\n"), F.col("p_type"), F.lit(" "), F.col("p_size").cast("string"), F.lit("\nrest "), F.col("p_brand"), F.lit("\nend"))
    return p.select("p_partkey", F.array_join(text.whole_lines(body), "|").alias("lines"), text.section(body, ["of", r"\brest\b"], ["rest", "end$"]).alias("section"))


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with a digit more than is shown, so that none is a half."""
    v = F.round(F.col("c_acctbal") / 100, 1) + 0.03
    return read(spark, sf_dir, "customer").select("c_custkey", text.money_label(v, F.when(F.col("c_mktsegment") == "BUILDING", "eur").when(F.col("c_mktsegment") == "MACHINERY", "chf"), wrap=True).alias("money"), text.percent_label(v, signed=True).alias("percent"), text.percent_label(F.when(v > 0, F.round(v, 0) + 0.03), compact=True).alias("compact"), text.points_label(v, "YoY").alias("points"))


def error_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    null = F.lit(None).cast("string")
    detail = F.struct(F.concat(F.lit(" "), "event_type").alias("message"), null.alias("error"), F.when(F.col("value") > 30, "warning").alias("severity"), F.lit("").alias("layer"), null.alias("source"), null.alias("phase"), null.alias("kind"), F.lit("io").alias("type"))
    blank = detail.withField("message", F.lit("  "))
    rows = e.select("event_id", F.when(F.col("value") > 20, F.array(F.concat("event_type", F.lit(" ")), F.lit(" "))).alias("errors"), F.when(F.col("value") < 40, F.array(blank, detail)).alias("details"))
    errors, details = text.error_bundle(F.col("errors"), F.col("details"), "parser", "events")
    return rows.select("event_id", F.array_join(errors, "|").alias("errors"), F.array_join(F.transform(details, lambda d: F.concat_ws("/", d["message"], d["severity"], d["layer"], d["source"], d["kind"])), "|").alias("details"))


def outlier_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 100) / 100).join(statements(spark, sf_dir).select(*QUARTER, "revenue"), QUARTER)
    return repairs.neighbour_mean(rows, "RF", 0.255).select(*QUARTER, "member", "value", "replaced")


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).join(statements(spark, sf_dir).select(*QUARTER, "revenue"), QUARTER)
    whole = F.when(F.col("company") % 3 == 0, F.round(F.col("revenue") * 1.6, 3)).when(F.col("company") % 3 == 1, F.round(F.col("revenue") * 1.06, 3)).otherwise(F.col("revenue"))
    told = rows.select(*QUARTER, "member", "value", whole.alias("_w"), "revenue")
    rest = told.select(*QUARTER, F.lit("otherrevenue").alias("member"), F.round(F.col("_w") - F.col("revenue"), 3).alias("value"), "_w", "revenue").distinct().filter("value > 0.03")
    return told.unionByName(rest).select(*QUARTER, "member", "value", F.col("_w").alias("revenue"))


def drop_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.drop_sparse(_residuals(spark, sf_dir), ["NF"])


def absorb_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.absorb_residual(_residuals(spark, sf_dir)).select(*QUARTER, "member", "value")


def synthetic_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _residuals(spark, sf_dir).withColumn("source", F.when(F.col("q_ord") % 4 == 0, "official-groups").when(F.col("q_ord") % 4 == 1, "official-segments"))
    return checks.synthetic_residuals(rows)


def classification_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = statements(spark, sf_dir).select(*QUARTER, (F.col("revenue") > F.col("cost") * 1.585).alias("has_revenue"), (F.col("tax") > 0.041 * F.col("revenue")).alias("has_expense"))
    r = F.col("n_regionkey")
    policies = read(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("company"), (r < 2).alias("gap_allowed"), F.when(r == 0, "late").alias("gap_reason"), (r > 0).alias("need_expense"), (r == 2).alias("expense_gap_allowed"))
    return checks.classification(entries, policies)


QUERIES = {f.__name__: f for f in (best_fact, best_segment_fact, best_axis, last_writer, merge_newest, merge_canonical, best_candidate, best_expenses, suspicious_expenses, opex_overflow_skips, validation_eligibility, policy_quarters, epoch_members, shares_to_values, scale_flows, accepted_breakdowns, ordered_members, loose_quarter, merge_filings, preserve_lists, null_bridge, attach_structure, resolve_names, ticker_numbers, statement_lines, display_labels, error_bundles, outlier_neighbours, drop_sparse, absorb_residual, synthetic_residuals, classification_coverage)}

_FACT = """f AS (SELECT user_id AS company, event_type AS concept, CAST(date_trunc('quarter', ts) AS DATE) AS start, last_day(ts) AS "end", CAST(ts AS DATE) + CAST(floor(value) AS INTEGER) AS filed, CAST(event_id AS VARCHAR) AS accession, event_id % 2 AS ns, event_id % 3 AS cp,
    CASE event_id % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' ELSE '10-q' END AS form, value FROM events), g AS (SELECT *, filed - "end" AS gap, "end" - start + 1 AS days FROM f)"""
_CAND = f"""{_ST}, {_SEG}, pri AS (SELECT CAST(c_nationkey AS BIGINT) AS company, {_Q.format('o_orderdate')} AS q_ord, o_orderpriority AS member, CAST(round(sum(CAST(o_totalprice AS DECIMAL(15, 2))), 3) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    cand AS (SELECT x.*, revenue FROM (SELECT company, q_ord, member, value, 'lines' AS source, 1 AS o, 600 AS lag FROM seg UNION ALL SELECT *, 'orders', 0, 40 FROM pri) x JOIN st USING (company, q_ord))"""
_TOLD = "t AS (SELECT user_id, event_type, event_id, CAST(date_trunc('month', ts) AS DATE) AS filed, value, 'n' || event_id AS name, CASE WHEN value > 20 THEN 'z' || event_id END AS name_zh FROM events)"
_FOLD = """SELECT user_id, event_type, list_reduce(list({filed: filed, value: value, name: name, name_zh: name_zh} ORDER BY event_id), lambda a, b: {filed: CASE WHEN %s THEN b.filed ELSE a.filed END, value: greatest(a.value, b.value), name: CASE WHEN %s THEN b.name ELSE a.name END,
    name_zh: CASE WHEN %s THEN coalesce(b.name_zh, a.name_zh) ELSE coalesce(a.name_zh, b.name_zh) END}) AS r FROM t GROUP BY 1, 2"""
_NEW, _CANON = "(b.filed > a.filed OR (b.filed = a.filed AND b.value > a.value))", "(b.filed > a.filed OR (b.filed = a.filed AND CASE WHEN abs(b.value - a.value) > 0.002 THEN b.value > a.value ELSE length(b.name) > length(a.name) END))"
_RES = f"""{_SEG}, {_ST}, w AS (SELECT company, q_ord, revenue AS own, CASE company % 3 WHEN 0 THEN round(revenue * 1.6::DOUBLE, 3) WHEN 1 THEN round(revenue * 1.06::DOUBLE, 3) ELSE revenue END AS revenue FROM st),
    res AS (SELECT seg.*, w.revenue FROM seg JOIN w USING (company, q_ord) UNION ALL SELECT company, q_ord, 'otherrevenue', round(revenue - own, 3), revenue FROM w WHERE round(revenue - own, 3) > 0.03 AND EXISTS (SELECT 1 FROM seg WHERE seg.company = w.company AND seg.q_ord = w.q_ord))"""
_CYCLE = "CASE q_ord % 4 WHEN 1 THEN 'half-year' WHEN 3 THEN 'annual' ELSE 'quarterly' END"
_GEO = "americas|asia pacific|canada|china|domestic|emea|europe|foreign|international|japan|latin america|north america|rest of world|south america|united states|worldwide"

ORACLE_SQL = {
    "best_fact": f"""WITH {_FACT} SELECT company, concept, start, "end", accession, value FROM g QUALIFY row_number() OVER (PARTITION BY company, concept, start, "end" ORDER BY gap BETWEEN 0 AND 210 DESC, greatest(gap, 0), ns DESC, cp DESC, filed DESC, accession DESC) = 1""",
    "best_segment_fact": f"""WITH {_FACT}, h AS (SELECT *, CASE WHEN (days BETWEEN 45 AND 120 AND form = '10-q') OR (days NOT BETWEEN 45 AND 120 AND form = '10-K') THEN 3 WHEN form IN ('10-q', '10-K') THEN 2 ELSE 1 END AS suits,
        CASE WHEN gap < -2 THEN 0 WHEN gap <= 220 THEN 5 WHEN gap <= 450 THEN 4 ELSE 3 END AS bucket, CASE WHEN gap < -2 THEN -9999 WHEN gap <= 220 THEN -abs(gap - 45) WHEN gap <= 450 THEN -abs(gap - 120) ELSE -abs(gap - 240) END AS near FROM g)
        SELECT company, concept, start, "end", form, filed, value FROM h QUALIFY row_number() OVER (PARTITION BY company, concept, start, "end" ORDER BY cp DESC, suits DESC, bucket DESC, near DESC, abs(days - 91), filed DESC, value DESC) = 1""",
    "best_axis": f"""WITH l AS (SELECT l_suppkey AS company, l_partkey, l_orderkey, {_Q.format('l_shipdate')} AS q FROM lineitem),
        f AS (SELECT company, 'ProductOrServiceAxis' AS axis, 80 AS p, p_type AS member, q FROM l JOIN part ON l_partkey = p_partkey UNION ALL SELECT company, 'StatementBusinessSegmentsAxis', 70, p_brand, q FROM l JOIN part ON l_partkey = p_partkey
            UNION ALL SELECT company, 'StatementGeographicalAxis', 100, n_name, q FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
        a AS (SELECT company, axis, max(p) AS p, count(DISTINCT member) AS n, count(DISTINCT q) AS n_periods, count(DISTINCT CASE WHEN regexp_matches(lower(member), '{_GEO}') THEN member END) AS geo, sum(2) AS w FROM f GROUP BY 1, 2),
        s AS (SELECT *, p + CASE WHEN axis LIKE 'Product%' AND n >= 3 AND geo = 0 THEN 28 WHEN axis LIKE '%Business%' AND n >= 2 AND geo = 0 THEN 12 ELSE 0 END - CASE WHEN geo / n >= 0.95 THEN 90 WHEN geo / n >= 0.66 THEN 70 WHEN geo / n >= 0.4 THEN 36 ELSE 0 END - CASE WHEN n < 2 THEN 18 ELSE 0 END - CASE WHEN n > 12 THEN 10 ELSE 0 END AS score FROM a)
        SELECT company, axis, CAST(score AS BIGINT) AS score, n_periods, n AS n_specific FROM s QUALIFY row_number() OVER (PARTITION BY company ORDER BY score DESC, n_periods DESC, n BETWEEN 2 AND 8 DESC, n DESC, w DESC, axis) = 1""",
    "last_writer": f"""WITH {_SEG}, o AS (
        SELECT company, q_ord, 'members' AS source, 0 AS o, 'segments' AS kind, count(*) AS n_rows FROM seg GROUP BY 1, 2
        UNION ALL SELECT c_nationkey, {_Q.format('o_orderdate')}, 'orders', 1, 'structure', count(DISTINCT o_orderpriority) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2
        UNION ALL SELECT s_nationkey, {_Q.format('l_shipdate')}, 'lines', 2, 'segments', count(DISTINCT l_linenumber) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45 GROUP BY 1, 2)
        SELECT company, q_ord, source, kind, n_rows FROM (SELECT * FROM o QUALIFY o >= coalesce(max(CASE WHEN kind = 'structure' THEN o END) OVER (PARTITION BY company, q_ord), -1)) QUALIFY row_number() OVER (PARTITION BY company, q_ord ORDER BY n_rows DESC, o DESC) = 1""",
    "merge_newest": f"WITH {_TOLD}, x AS ({_FOLD % ((_NEW,) * 3)}) SELECT user_id, event_type, r.* FROM (SELECT user_id, event_type, r FROM x)",
    "merge_canonical": f"WITH {_TOLD}, x AS ({_FOLD % ((_CANON,) * 3)}) SELECT user_id, event_type, r.filed AS filed, r.value AS value, r.name AS name FROM x",
    "best_candidate": f"""WITH {_CAND}, a AS (SELECT company, q_ord, source, o, count(*) AS n, sum(value) AS s, max(value) AS top, max(lag) AS lag, max(revenue) AS revenue FROM cand GROUP BY 1, 2, 3, 4), b AS (SELECT *, s / revenue AS ratio, abs(s / revenue - 1) AS off FROM a),
        c AS (SELECT *, CASE WHEN n >= 2 THEN 22 ELSE -14 END + CASE WHEN n >= 3 THEN 5 ELSE 0 END + CASE WHEN off <= 0.08 THEN 18 WHEN off <= 0.25 THEN 10 WHEN ratio < 0.36 OR ratio > 1.4 THEN -18 ELSE 2 END - CASE WHEN top / s > 0.84 AND n >= 3 THEN 8 ELSE 0 END + CASE WHEN lag > 540 THEN -10 ELSE 3 END AS score FROM b)
        SELECT company, q_ord, source, n AS n_rows, CAST(score AS BIGINT) AS score FROM c QUALIFY row_number() OVER (PARTITION BY company, q_ord ORDER BY score DESC, round(off, 9), n DESC, o) = 1""",
    "best_expenses": f"""WITH {_CAND}, a AS (SELECT company, q_ord, source, o, count(*) AS n, sum(value) AS s, max(revenue) AS t FROM cand GROUP BY 1, 2, 3, 4 HAVING count(*) >= 1),
        c AS (SELECT *, round(n * 100 + least(s, t) - greatest(abs(s - t) - 0.2, 0) * 10, 3) AS score FROM a) SELECT company, q_ord, source AS candidate, n AS n_rows, score FROM c QUALIFY row_number() OVER (PARTITION BY company, q_ord ORDER BY score DESC, o) = 1""",
    "suspicious_expenses": f"""WITH {_ST} SELECT company, q_ord, round(tax, 3) > 0.02 AND q_ord % 2 = 0 AND (company % 3 = 0 OR tax * 4 > total * 1.35 + greatest(total * 0.03, 0.35) OR tax > total * 1.08 + greatest(total * 0.01, 0.12) OR q_ord % 8 < 4) AS suspicious
        FROM (SELECT *, CASE WHEN q_ord % 4 = 2 THEN tax * 5 ELSE tax * 2 END AS total FROM st)""",
    "opex_overflow_skips": f"""WITH {_SEG}, {_ST}, r AS (SELECT seg.*, CASE WHEN q_ord % 2 = 0 THEN revenue / 1.1::DOUBLE ELSE cost END AS opex FROM seg JOIN st USING (company, q_ord)),
        a AS (SELECT company, q_ord, round(sum(abs(value)), 3) AS s, max(opex) AS t, count(*) AS n, bool_and(member IN ('AF', 'NF', 'NO', 'RF', 'RO')) AS fit FROM r GROUP BY 1, 2) SELECT company, q_ord, fit AND n >= 2 AND s - t > greatest(0.12, t * 0.03) AND (s / t <= 1.12 OR (n = 3 AND s / t <= 1.4)) AS skipped FROM a""",
    "validation_eligibility": f"""WITH {_SEG}, {_ST}, n AS (SELECT company, q_ord, {_CYCLE} AS note FROM st WHERE tax > 0.04::DOUBLE * revenue), m AS (SELECT seg.*, note, CASE WHEN member = 'RF' THEN 'half-year' ELSE 'checked' END AS had FROM seg LEFT JOIN n USING (company, q_ord))
        SELECT company, q_ord, member, value, note IS NULL AS eligible, CASE WHEN note IS NULL OR note = had THEN had ELSE had || '|' || note END AS notes FROM m""",
    "policy_quarters": f"""WITH {_ST}, q AS (SELECT company, q_ord, revenue > cost * 1.585::DOUBLE AS has_revenue, tax > 0.0395::DOUBLE * revenue AS has_expense, n_regionkey AS r, n_nationkey AS n FROM st LEFT JOIN nation ON n_nationkey = company),
        g AS (SELECT *, NOT coalesce(r < 4, false) OR ((r > 2 OR (r = 0 AND q_ord % 4 = 3) OR (r = 1 AND q_ord % 4 IN (1, 3))) AND (n % 3 = 0 OR has_revenue) AND (n % 2 <> 0 OR has_expense)) AS good FROM q)
        SELECT company, q_ord, has_revenue, has_expense FROM g QUALIFY good OR NOT max(good) OVER (PARTITION BY company)""",
    "epoch_members": f"""WITH {_SEG}, f AS (SELECT *, min(q_ord) OVER (PARTITION BY company) AS first FROM seg), m AS (SELECT *, max(CASE WHEN member IN ('AF', 'RF') THEN 1 ELSE 0 END) OVER w = 1 AND max(CASE WHEN member = 'NO' THEN 1 ELSE 0 END) OVER w = 1 AS mixed,
        CASE WHEN q_ord >= first + 14 THEN member IN ('NF', 'NO') ELSE member IN ('AF', 'RF', 'NF') END AS good FROM f WINDOW w AS (PARTITION BY company, q_ord)) SELECT company, q_ord, member, value FROM m WHERE NOT mixed OR good""",
    "shares_to_values": f"""WITH {_SEG}, {_ST}, r AS (SELECT seg.*, revenue, round(value / revenue * 100, 2) AS share FROM seg JOIN st USING (company, q_ord)), t AS (SELECT *, count(*) OVER w >= 2 AND max(share) OVER w <= 100.5 AND abs(sum(share) OVER w - 100) <= 4.5 AS shape FROM r WINDOW w AS (PARTITION BY company, q_ord)),
        v AS (SELECT company, q_ord, member, CASE company % 4 WHEN 1 THEN round(revenue * share / 100, 3) WHEN 2 THEN floor(value / 2) WHEN 0 THEN CASE WHEN shape THEN round(revenue * share / 100, 3) ELSE share END ELSE value END AS value FROM t) SELECT company, q_ord, member, value FROM v WHERE value > 0.02""",
    "scale_flows": f"""WITH {_SEG}, {_ORD}, s AS (SELECT seg.company, seg.q_ord, member, value, revenue, sum(value) OVER (PARTITION BY seg.company, seg.q_ord) AS total FROM seg JOIN ord USING (company, q_ord)),
        p AS (SELECT *, total > revenue + greatest(0.02, revenue * 0.002) AS scaled, round(value * revenue / total, 3) AS part, row_number() OVER w = count(*) OVER (PARTITION BY company, q_ord) AS last FROM s WINDOW w AS (PARTITION BY company, q_ord ORDER BY member)),
        b AS (SELECT *, coalesce(sum(part) OVER (PARTITION BY company, q_ord ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT company, q_ord, member, CASE WHEN NOT scaled THEN value WHEN last THEN round(greatest(revenue - before, 0), 3) ELSE part END AS flow, scaled FROM b""",
    "accepted_breakdowns": f"WITH {_SEG}, {_ORD}, a AS (SELECT company, q_ord, sum(value) AS s FROM seg GROUP BY 1, 2) SELECT a.company, a.q_ord, CASE WHEN revenue > 0 THEN round(s / revenue, 9) BETWEEN 0.5 AND 2 ELSE true END AS accepted FROM a LEFT JOIN ord USING (company, q_ord)",
    "ordered_members": f"WITH {_SEG} SELECT *, row_number() OVER (PARTITION BY company, q_ord ORDER BY CASE member WHEN 'RF' THEN 1 WHEN 'NO' THEN 2 END NULLS LAST, value DESC, member) AS place FROM seg",
    "loose_quarter": f"WITH {_ST} SELECT company * 100000 + q_ord AS entry, CASE WHEN q_ord % 4 = 0 OR q_ord % 3 <> 1 OR NOT tax > 0.0395::DOUBLE * revenue THEN q_ord END AS q_ord FROM st",
    "merge_filings": "SELECT CAST(event_id AS VARCHAR) AS accession, CASE WHEN value > 10 AND value < 30 OR value < 40 THEN event_type END AS event_type, CASE WHEN value > 10 THEN value ELSE 1.5 END AS value FROM events WHERE value > 10 OR value < 40",
    "preserve_lists": f"""WITH {_SEG}, {_ST}, m AS (SELECT company, q_ord, string_agg(member, '|' ORDER BY member) AS members FROM seg GROUP BY 1, 2), f AS (SELECT st.*, m.members, tax > 0.039::DOUBLE * revenue AND m.members IS NOT NULL AS fresh FROM st LEFT JOIN m USING (company, q_ord))
        SELECT company, q_ord, CASE WHEN fresh THEN revenue ELSE 1.0 END AS revenue, CASE WHEN fresh AND company % 3 = 1 THEN members ELSE 'old' END AS members FROM f""",
    "null_bridge": f"""WITH {_ST}, {_ORD}, j AS (SELECT st.*, ord.revenue AS gross, q_ord % 2 = 0 AND greatest(cost, ord.revenue) > st.revenue * 1.18::DOUBLE AS bad FROM st JOIN ord USING (company, q_ord))
        SELECT company, q_ord, revenue, CASE WHEN NOT bad THEN cost END AS cost, CASE WHEN NOT bad THEN tax END AS tax, CASE WHEN NOT bad THEN gross END AS gross, CASE WHEN bad THEN 'aligned|cleared' WHEN q_ord % 2 = 0 THEN 'aligned' ELSE '' END AS flags FROM j""",
    "attach_structure": f"""WITH {_CAND}, s AS (SELECT company, q_ord, count(*) AS n, round(sum(value), 3) AS total FROM cand WHERE source = 'orders' GROUP BY 1, 2), e AS (SELECT company, q_ord, revenue, true AS own FROM st WHERE tax > 0.0395::DOUBLE * revenue)
        SELECT company, q_ord, CASE WHEN own THEN revenue WHEN q_ord % 2 = 0 THEN 1.25 ELSE total END AS revenue, coalesce(n, 0) AS n_rows, CASE WHEN own THEN 'entry' ELSE 'structure' END AS source FROM e FULL JOIN s USING (company, q_ord)""",
    "resolve_names": """WITH a AS (SELECT lower(n_name) AS alias, n_nationkey AS company, 0 AS o FROM nation UNION ALL SELECT lower(left(n_name, 2)), n_nationkey, 1 FROM nation),
        q AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN lower(n_name) WHEN 'MACHINERY' THEN left(lower(n_name), 4) WHEN 'FURNITURE' THEN substr(lower(n_name), 2, 3) ELSE lower(c_mktsegment) || lower(n_name) END AS query FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT c_custkey, CAST(company AS BIGINT) AS company, query = alias AS exact FROM q LEFT JOIN a ON contains(query, alias) OR contains(alias, query) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o, query <> alias, company) = 1""",
    "ticker_numbers": "SELECT c_custkey, s_suppkey AS number FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    "statement_lines": r"""SELECT p_partkey, 'Net ' || trim(regexp_replace(p_name, '\s+', ' ', 'g')) || ' of ' || p_type || ' ' || p_size || '|rest ' || p_brand || CASE WHEN regexp_matches(p_brand, '\d(\s|$)') THEN '|end' ELSE ' end' END AS lines,
        regexp_extract('Net' || chr(10) || p_name || '  of' || chr(13) || chr(10) || chr(10) || p_type || ' ' || p_size || chr(10) || 'rest ' || p_brand || chr(10) || 'end', '(?is)(of.*?)(rest|end$)', 1) AS section FROM part""",
    "display_labels": """WITH v AS (SELECT c_custkey, c_mktsegment AS m, round(c_acctbal / 100, 1) + 0.03::DOUBLE AS v FROM customer), d AS (SELECT *, CAST(CAST(round(v, 1) AS DECIMAL(20, 1)) AS VARCHAR) AS t, CAST(CAST(round(abs(v), 1) AS DECIMAL(20, 1)) AS VARCHAR) AS p, CASE m WHEN 'BUILDING' THEN '€' WHEN 'MACHINERY' THEN 'CHF ' ELSE '$' END AS c FROM v)
        SELECT c_custkey, CASE WHEN v < 0 THEN '(' || c || p || 'B)' ELSE c || p || 'B' END AS money, CASE WHEN v >= 0 THEN '+' ELSE '' END || t || '%' AS percent, coalesce(CASE WHEN v > 0 THEN CAST(CAST(round(v, 0) AS BIGINT) AS VARCHAR) || '%' END, '-') AS compact, 'YoY ' || CASE WHEN v >= 0 THEN '+' ELSE '' END || regexp_replace(t, '\\.0$', '') || 'pp' AS points FROM d""",
    "error_bundles": """SELECT event_id, CASE WHEN value > 20 OR value < 40 THEN event_type ELSE '' END AS errors, CASE WHEN value < 40 THEN event_type || CASE WHEN value > 30 THEN '/warning' ELSE '/error' END || '/parser/events/io' WHEN value > 20 THEN event_type || '/error/parser/events' ELSE '' END AS details FROM events""",
    "outlier_neighbours": f"""WITH {_SEG.replace("seg AS", "sg AS")}, seg AS (SELECT company, q_ord, member, floor(value * 100) / 100 AS value FROM sg), {_ST}, o AS (SELECT * FROM seg WHERE member = 'RF' AND value > 0), m AS (SELECT a.company, a.q_ord, round(avg(b.value), 3) AS mean FROM (SELECT DISTINCT company, q_ord FROM seg) a JOIN o b ON b.company = a.company AND abs(b.q_ord - a.q_ord) = 1 AND b.q_ord // 4 = a.q_ord // 4 GROUP BY 1, 2),
        j AS (SELECT seg.*, coalesce(member = 'RF' AND value / revenue > 0.255 AND mean > 0, false) AS replaced, mean FROM seg JOIN st USING (company, q_ord) LEFT JOIN m USING (company, q_ord)) SELECT company, q_ord, member, CASE WHEN replaced THEN mean ELSE value END AS value, replaced FROM j""",
    "drop_sparse": f"""WITH {_RES}, p AS (SELECT *, coalesce(coalesce(sum(CASE WHEN member <> 'otherrevenue' THEN value END) OVER w, 0) / revenue < 0.72 AND max(CASE WHEN member = 'otherrevenue' THEN value END) OVER w / revenue > 0.28, false) AS sparse FROM res WINDOW w AS (PARTITION BY company, q_ord))
        SELECT company, q_ord, member, value, revenue FROM p WHERE NOT sparse AND NOT (member = 'NF' AND value / revenue < 0.015) UNION ALL SELECT DISTINCT company, q_ord, 'reportedrevenue', round(revenue, 3), revenue FROM p WHERE sparse""",
    "absorb_residual": f"""WITH {_RES}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY company, q_ord) AS share FROM res), q AS (SELECT company, q_ord, string_agg(DISTINCT member, '|' ORDER BY member) FILTER (member <> 'otherrevenue') AS own, max(value) FILTER (member = 'otherrevenue') AS rest, max(revenue) AS revenue FROM res GROUP BY 1, 2),
        n AS (SELECT *, lag(own) OVER w AS before, lead(own) OVER w AS after, lag(q_ord) OVER w AS bq, lead(q_ord) OVER w AS aq FROM q WINDOW w AS (PARTITION BY company ORDER BY q_ord)), g AS (SELECT * FROM n WHERE before = own AND after = own AND rest / revenue > 0.01 AND rest / revenue <= 0.1),
        x AS (SELECT r.*, g.rest, (b.share + a.share) / 2 AS w FROM res r LEFT JOIN g USING (company, q_ord) LEFT JOIN s b ON b.company = r.company AND b.q_ord = g.bq AND b.member = r.member LEFT JOIN s a ON a.company = r.company AND a.q_ord = g.aq AND a.member = r.member)
        SELECT company, q_ord, member, CASE WHEN rest IS NULL THEN value ELSE round(value + rest * w / sum(CASE WHEN member <> 'otherrevenue' THEN w END) OVER (PARTITION BY company, q_ord), 3) END AS value FROM x QUALIFY rest IS NULL OR member <> 'otherrevenue'""",
    "synthetic_residuals": f"WITH {_RES} SELECT company, q_ord, round(value / revenue, 3) AS residual_share FROM res WHERE member = 'otherrevenue' AND q_ord % 4 <> 0",
    "classification_coverage": f"""WITH {_ST}, e AS (SELECT company, q_ord, revenue > cost * 1.585::DOUBLE AS r, tax > 0.041::DOUBLE * revenue AS x FROM st),
        c AS (SELECT company, count(*) AS n_quarters, max(q_ord) AS latest, count(*) FILTER (r) AS n_revenue, count(*) FILTER (x) AS n_expense, max(q_ord) FILTER (r) AS latest_revenue, max(q_ord) FILTER (x) AS latest_expense FROM e GROUP BY 1),
        p AS (SELECT c.*, coalesce(n_regionkey < 2, false) AS gap, coalesce(n_regionkey = 0, false) AS reason, coalesce(n_regionkey > 0, false) AS need, coalesce(n_regionkey = 2, false) AS xgap, NOT coalesce(latest_revenue = latest, false) AS nr, NOT coalesce(latest_expense = latest, false) AS nx FROM c LEFT JOIN nation ON n_nationkey = company AND n_nationkey < 20),
        w AS (SELECT *, concat_ws(',', CASE WHEN nr AND gap AND reason THEN 'latest-revenue-gap' END, CASE WHEN n_revenue > 0 AND n_revenue < least(n_quarters, 4) THEN 'sparse-revenue' END, CASE WHEN n_expense > 0 AND n_expense < least(n_quarters, 4) THEN 'sparse-expense' END, CASE WHEN n_revenue = 0 THEN 'no-revenue' END, CASE WHEN need AND n_expense = 0 THEN 'no-expense' END) AS warnings,
            concat_ws(',', CASE WHEN nr AND NOT (gap AND reason) THEN 'latest-revenue-missing' END, CASE WHEN nx AND need AND NOT xgap THEN 'latest-expense-missing' END) AS blockers FROM p)
        SELECT company, n_quarters, latest, n_revenue, n_expense, latest_revenue, latest_expense, round(n_revenue / n_quarters, 4) AS revenue_share, round(n_expense / n_quarters, 4) AS expense_share, latest - latest_revenue AS revenue_lag, latest - latest_expense AS expense_lag, warnings, blockers,
            CASE WHEN blockers <> '' THEN 'error' WHEN gap AND nr THEN 'exception' WHEN warnings <> '' THEN 'warning' ELSE 'ok' END AS status FROM w""",
}

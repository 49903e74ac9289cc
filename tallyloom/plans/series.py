"""Queries over periods, growth, labels and histories, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import growth, history, labels, periods
from tallyloom.plans.mending import QUARTER, _SPARSE, _sparse
from tallyloom.plans.queries import _SEG, _SP, _ST
from tallyloom.sources.tables import read, segments, sparse_statements, statements


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct quarters of some cells, and cumulated spans of most."""
    sparse = sparse_statements(spark, sf_dir)
    ytd = periods.cumulative(sparse).filter((F.col("company") + F.col("q_ord")) % 5 != 0).select(*QUARTER, (F.col("q_ord") % 4 + 1).alias("span"), F.col("ytd").alias("value"), F.lit(1).alias("mode"), F.col("q_ord").alias("filed"))
    direct = sparse.filter((F.col("company") * 3 + F.col("q_ord")) % 7 == 0).select(*QUARTER, F.lit(1).cast("long").alias("span"), F.col("revenue").alias("value"), F.lit(2).alias("mode"), F.col("q_ord").alias("filed"))
    return ytd.unionByName(direct)


def finalize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.finalize(periods.merge_periods(_spans(spark, sf_dir)))


def member_quarterize_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    years = rows.groupBy("company", F.floor(F.col("q_ord") / 4).alias("_y"), "member").agg(F.round(F.sum("value"), 3).alias("value"))
    cumulated = years.select("company", (F.col("_y") * 4 + 3).alias("q_ord"), F.lit(4).cast("long").alias("span"), "member", "value")
    direct = rows.filter((F.col("q_ord") % 4 < 3) & ~(((F.col("company") + F.col("q_ord")) % 6 == 0) & (F.col("member") == "RF")) | (F.col("member") == "AF"))
    return periods.member_quarters(cumulated, direct)


def covered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda q, add: F.make_date(F.floor(q / 4).cast("int"), (q % 4 * 3 + add).cast("int"), F.lit(1))
    own = statements(spark, sf_dir)
    facts = own.filter((F.col("company") + F.col("q_ord")) % 9 != 0).select("company", day(F.col("q_ord"), 1).alias("start"), F.last_day(day(F.col("q_ord"), 3)).alias("end"), F.col("revenue").alias("value"))
    year = own.groupBy("company", F.floor(F.col("q_ord") / 4).alias("_y")).agg(F.round(F.sum("revenue"), 3).alias("value"))
    cumulated = year.select("company", day(F.col("_y") * 4, 1).alias("start"), F.last_day(day(F.col("_y") * 4 + 3, 3)).alias("end"), "value")
    return periods.uncovered(cumulated, facts)


def quarterised_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date facts of the quarters a part has, filed 40 days after their ends; years without their first quarters yield less."""
    day = lambda q, add: F.make_date(F.floor(q / 4).cast("int"), (q % 4 * 3 + add).cast("int"), F.lit(1))
    end = F.last_day(day(F.col("q_ord"), 3))
    ytd = periods.cumulative(sparse_statements(spark, sf_dir))
    facts = ytd.select("company", day(F.floor(F.col("q_ord") / 4) * 4, 1).alias("start"), end.alias("end"), F.col("ytd").alias("value"), F.lit(1).alias("concept_priority"), F.lit(20).alias("namespace_priority"), F.date_add(end, 40).alias("filed"), F.lit("").alias("accession"))
    return periods.quarterise(facts, ["company"], first=0)


def growth_margin_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = F.round((F.col("revenue") - F.col("cost")) / F.col("revenue") * 100, 3)
    return growth.margin_deltas(statements(spark, sf_dir).select(*QUARTER, "revenue", margin.alias("margin")).filter((F.col("company") + F.col("q_ord")) % 5 != 0))


def fx_adjusted_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = growth.calendar(statements(spark, sf_dir).select(*QUARTER, "revenue"), overwrite=True).select(*QUARTER, "yoy")
    return growth.fx_adjusted(df.withColumn("scale", F.when(F.col("q_ord") % 7 != 0, 1 + F.col("q_ord") % 5 / 10)))


def weighted_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.weighted_mean(growth.mix(segments(spark, sf_dir)).withColumn("parent", F.substring("member", 1, 1)), [*QUARTER, "parent"], "yoy")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Sales & Distribution", "Advertising", "Total operating expenses", "Corporate overhead", "Interest and other expense", "Product development", "Office expense", "Credit loss provisions", "Elephants", "Elephants Segment")
    label = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("l_orderkey") % 10 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_linenumber").cast("long").alias("q_ord"), label.alias("label"), F.col("l_quantity").alias("value"))


def taxonomy_sum_or_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.normalize_breakdown(_labelled(spark, sf_dir), "opex", QUARTER)


def combined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Cloud and Devices", "Cloud", "Devices", "Other Cloud", "Consolidated Cloud", "Games")
    name = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("l_orderkey") % 6 + 1).cast("int"))
    return labels.combined(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("company"), name.alias("member")).distinct(), ["company"])


def generic_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ProductMember", "ServiceMember", "CloudMember", "PhonesMember", "OperatingSegmentsMember")
    name = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return labels.drop_generic(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("company"), name.alias("member")).distinct(), ["company"])


def addable_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.within_taxonomy(_sparse(spark, sf_dir), QUARTER, ["A", "R"])


def taxonomy_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).join(statements(spark, sf_dir).select(*QUARTER, "revenue"), QUARTER)
    return history.phases(rows)


def history_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.fill_gaps(_sparse(spark, sf_dir))


def subset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's quantity by part type and flag against half its quantity, of whole units."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_returnflag")
    rows = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey").groupBy(F.col("l_suppkey").alias("company"), F.lit(0).cast("long").alias("q_ord"), F.concat_ws(" ", "p_type", "l_returnflag").alias("member")).agg(F.sum("l_quantity").alias("value"))
    whole = lines.groupBy(F.col("l_suppkey").alias("company")).agg((F.sum("l_quantity") / 2).alias("revenue"))
    return history.best_subset(rows.join(whole, "company").withColumn("penalty", F.lit(0.0)).withColumn("tokens", F.split("member", " ")))


def subset_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's quantity by metal and whether it came back, against a share of it; two metals count as sums, some suppliers have targets or a style."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_returnflag")
    member = F.concat_ws(" ", F.element_at(F.split("p_type", " "), -1), F.when(F.col("l_returnflag") == "N", "KEPT").otherwise("BACK"))
    rows = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey").groupBy(F.col("l_suppkey").alias("company"), F.lit(0).cast("long").alias("q_ord"), member.alias("member")).agg(F.sum("l_quantity").cast("double").alias("value"))
    share = F.element_at(F.array(*(F.lit(x) for x in (0.3125, 0.5, 0.5625, 0.75))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    whole = lines.groupBy("l_suppkey").agg(F.sum("l_quantity").cast("double").alias("all")).select(F.col("l_suppkey").alias("company"), (F.col("all") * share).alias("revenue"))
    targets = F.when(F.col("company") % 3 == 0, F.array(F.lit("BRASS KEPT"), F.lit("STEEL BACK"))).when(F.col("company") % 9 == 1, F.array(F.lit("BRASS KEPT"), F.lit("GOLD")))
    rows = rows.join(whole, "company").withColumn("penalty", F.lit(0.0)).withColumn("tokens", F.split("member", " "))
    return history.best_subset(rows, aggregate=F.col("member").rlike("^(TIN|NICKEL) "), targets=targets, styled=F.col("company") % 5 == 0)


def layout_fit_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.fit_band(segments(spark, sf_dir).withColumnRenamed("value", "height"), 0.0, 400.0, 8.0, 24.0)


def conserved_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands between a member's costs and its share of taxes, both as heights."""
    rows = segments(spark, sf_dir).join(statements(spark, sf_dir).select(*QUARTER, "revenue", "tax"), QUARTER)
    heights = rows.select(*QUARTER, "member", (F.col("value") / F.col("revenue") * 300).alias("source_height"), (F.col("tax") / F.col("revenue") * 2000).alias("target_height"), (F.col("q_ord") % 100).cast("double").alias("target_center"))
    return history.conserved_bands(heights, 40.0)


def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("value") / F.col("revenue")
    rows = segments(spark, sf_dir).join(statements(spark, sf_dir).select(*QUARTER, "revenue"), QUARTER)
    return history.place_boxes(rows.select(*QUARTER, "member", (share * 400).alias("center"), (share * 200).alias("height")), 0.0, 400.0, 12.0)


QUERIES = {
    f.__name__: f
    for f in (finalize_spans, member_quarterize_abort, covered_range, quarterised_facts, growth_margin_deltas, fx_adjusted_growth, weighted_growth, taxonomy_sum_or_max, combined_labels, generic_members, addable_taxonomy, taxonomy_phases, history_gap_fill, subset_selection, subset_shortcuts, layout_fit_band, conserved_bands, layout_boxes)
}


def _positions() -> str:
    """One step for each place in the year: the quarter itself, or its span less the shorter span or the quarters before."""
    steps = ["f0 AS (SELECT company, q_ord, value, false AS derived FROM e WHERE span = 1)"]
    for p in range(1, 4):
        steps.append(f"""b{p} AS (SELECT c.company, c.q_ord, round(c.value - coalesce(s.value, p.total), 3) + 0.0 AS value FROM e c LEFT JOIN e s ON s.company = c.company AND s.q_ord = c.q_ord - 1 AND s.span = {p}
            LEFT JOIN LATERAL (SELECT CASE WHEN count(*) = {p} THEN sum(f.value) END AS total FROM f{p - 1} f WHERE f.company = c.company AND f.q_ord BETWEEN c.q_ord - {p} AND c.q_ord - 1) p ON true WHERE c.span = {p + 1}),
            f{p} AS (SELECT * FROM f{p - 1} UNION ALL SELECT company, q_ord, value, true FROM b{p} WHERE value >= -0.001 AND (company, q_ord) NOT IN (SELECT company, q_ord FROM f{p - 1}))""")
    return ", ".join(steps)


_YOY = f"{_ST}, g AS (SELECT s.company, s.q_ord, CASE WHEN p.revenue > 0 AND s.revenue > 0 THEN round((s.revenue / p.revenue - 1) * 100, 3) END AS yoy FROM st s LEFT JOIN st p ON p.company = s.company AND p.q_ord = s.q_ord - 4)"



def _subset(member: str, share: str, sums: str, targets: str, styled: str) -> str:
    """F14 with every set of rows as a mask."""
    return f"""WITH w AS (SELECT l_suppkey AS company, CAST(sum(l_quantity) AS DOUBLE) * {share} AS revenue FROM lineitem GROUP BY l_suppkey),
        r AS (SELECT l_suppkey AS company, {member} AS member, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
        top AS (SELECT *, {sums} AS sums FROM r JOIN w USING (company) WHERE value > 0.02 AND revenue > 0 QUALIFY row_number() OVER (PARTITION BY company ORDER BY value DESC, member) <= 12),
        few AS (SELECT * FROM top QUALIFY NOT sums OR count(*) OVER (PARTITION BY company) < 3 OR count(*) FILTER (NOT sums) OVER (PARTITION BY company) = 0),
        c AS (SELECT company, member, value, row_number() OVER (PARTITION BY company ORDER BY value DESC, member) - 1 AS i, string_split(member, ' ') AS tokens FROM few),
        q AS (SELECT company, any_value(revenue) AS revenue, count(*) AS n, sum(value) / any_value(revenue) AS ratio, {targets} AS targets, list(member) AS members, {styled} AS styled FROM few GROUP BY company),
        k AS (SELECT *, len(list_intersect(targets, members)) AS met FROM q),
        h AS (SELECT *, (met > 0 AND met = len(targets) AND n <= 7 AND ratio BETWEEN 0.72 AND 1.18) OR (styled AND ratio BETWEEN 0.78 AND 1.18) OR (n BETWEEN 3 AND 6 AND ratio BETWEEN 0.88 AND 1.18) AS whole FROM k),
        m AS (SELECT company, CAST(range AS BIGINT) AS mask FROM h, range(1, 4096) WHERE NOT whole AND range < (1 << CAST(n AS INTEGER))),
        s AS (SELECT company, mask, count(*) AS size, sum(value) AS total, list(member) AS names FROM m JOIN c USING (company) WHERE (mask >> CAST(i AS BIGINT)) & 1 = 1 GROUP BY company, mask),
        p AS (SELECT a.company, (1 << CAST(a.i AS BIGINT)) | (1 << CAST(b.i AS BIGINT)) AS pair, len(list_intersect(list_distinct(a.tokens), list_distinct(b.tokens))) AS shared FROM c a JOIN c b ON a.company = b.company AND a.i < b.i),
        o AS (SELECT m.company, mask, sum(shared) AS shared FROM m JOIN p ON p.company = m.company AND mask & pair = pair AND shared > 0 GROUP BY m.company, mask),
        x AS (SELECT s.company, mask, size, CASE WHEN size BETWEEN 3 AND 6 THEN 44 ELSE 0 END - abs(total - revenue) * 110 - CASE WHEN size > 5 THEN (size - 5) * 18 WHEN size < 3 AND n > 3 THEN (3 - size) * 40 ELSE 0 END
            - CASE WHEN total / revenue < 0.78 THEN (0.78 - total / revenue) * 260 WHEN total / revenue > 1.08 THEN (total / revenue - 1.08) * 360 ELSE 0 END - 28 * coalesce(shared, 0) AS score
            FROM s JOIN h USING (company) LEFT JOIN o USING (company, mask) WHERE size <= 7 AND (size > 1 OR n = 1) AND total / revenue BETWEEN 0.45 AND 1.35 AND (met = 0 OR len(list_intersect(targets, names)) = len(targets))),
        best AS (SELECT company, mask FROM x QUALIFY row_number() OVER (PARTITION BY company ORDER BY round(score, 6) DESC, size, mask) = 1)
        SELECT company, CAST(0 AS BIGINT) AS q_ord, member, value FROM c JOIN h USING (company) LEFT JOIN best USING (company) WHERE whole OR CASE WHEN mask IS NULL THEN i < 7 ELSE (mask >> CAST(i AS BIGINT)) & 1 = 1 END"""


ORACLE_SQL = {
    "subset_selection": _subset("p_type || ' ' || l_returnflag", "0.5", "false", "CAST([] AS VARCHAR[])", "false"),
    "subset_shortcuts": _subset("list_extract(string_split(p_type, ' '), -1) || CASE WHEN l_returnflag = 'N' THEN ' KEPT' ELSE ' BACK' END", "list_extract([0.3125, 0.5, 0.5625, 0.75], l_suppkey % 4 + 1)", "regexp_matches(member, '^(TIN|NICKEL) ')", "CASE WHEN company % 3 = 0 THEN ['BRASS KEPT', 'STEEL BACK'] WHEN company % 9 = 1 THEN ['BRASS KEPT', 'GOLD'] ELSE CAST([] AS VARCHAR[]) END", "company % 5 = 0"),
    "conserved_bands": f"""WITH {_ST}, {_SEG}, h AS (SELECT company, q_ord, member, greatest(least(value / revenue * 300, tax / revenue * 2000), 40) AS h, CAST(q_ord % 100 AS DOUBLE) AS spot FROM seg JOIN st USING (company, q_ord)) SELECT company, q_ord, member, spot - h / 2 AS top, spot + h / 2 AS bottom FROM h""",
    "finalize_spans": f"""WITH {_SP}, y AS (SELECT company, q_ord, round(sum(revenue) OVER (PARTITION BY company, q_ord // 4 ORDER BY q_ord), 3) AS ytd FROM sp),
        a AS (SELECT company, q_ord, q_ord % 4 + 1 AS span, ytd AS value, 1 AS mode FROM y WHERE (company + q_ord) % 5 <> 0 UNION ALL SELECT company, q_ord, 1, revenue, 2 FROM sp WHERE (company * 3 + q_ord) % 7 = 0),
        e AS (SELECT company, q_ord, span, arg_max(value, mode) AS value FROM a GROUP BY 1, 2, 3), {_positions()} SELECT * FROM f3""",
    "member_quarterize_abort": f"""WITH {_SEG}, c AS (SELECT company, q_ord // 4 AS y, member, round(sum(value), 3) AS value FROM seg GROUP BY 1, 2, 3),
        d AS (SELECT * FROM seg WHERE (q_ord % 4 < 3 AND NOT ((company + q_ord) % 6 = 0 AND member = 'RF')) OR member = 'AF'),
        j AS (SELECT c.company, c.y, c.member, c.value, count(d.value) AS n, sum(d.value) AS s FROM c LEFT JOIN d ON d.company = c.company AND d.member = c.member AND d.q_ord // 4 = c.y AND d.q_ord % 4 < 3 GROUP BY 1, 2, 3, 4),
        k AS (SELECT *, min(n) OVER (PARTITION BY company, y) AS least FROM j)
        SELECT company, y * 4 + 3 AS q_ord, member, round(value - s, 3) + 0.0 AS value FROM k WHERE least = 3 AND (company, y * 4 + 3, member) NOT IN (SELECT company, q_ord, member FROM d)""",
    "covered_range": f"""WITH {_ST}, f AS (SELECT company, CAST(make_date(q_ord // 4, q_ord % 4 * 3 + 1, 1) AS DATE) AS s, last_day(make_date(q_ord // 4, q_ord % 4 * 3 + 3, 1)) AS e, revenue AS v FROM st WHERE (company + q_ord) % 9 <> 0),
        c AS (SELECT company, make_date(q_ord // 4, 1, 1) AS s, make_date(q_ord // 4, 12, 31) AS e, round(sum(revenue), 3) AS v FROM st GROUP BY 1, 2, 3)
        SELECT c.company, max(f.e) + 1 AS start, c.e AS "end", round(c.v - sum(f.v), 3) + 0.0 AS value FROM c JOIN f ON f.company = c.company AND f.s >= c.s AND f.e < c.e GROUP BY c.company, c.s, c.e, c.v HAVING count(*) = greatest(round_even((c.e - c.s + 1) / 91, 0) - 1, 1)""",
    "quarterised_facts": f"""WITH {_SP}, y AS (SELECT company, q_ord, round(sum(revenue) OVER w, 3) AS ytd, count(*) OVER w AS n FROM sp WINDOW w AS (PARTITION BY company, q_ord // 4 ORDER BY q_ord)),
        l AS (SELECT *, lag(ytd) OVER (PARTITION BY company, q_ord // 4 ORDER BY q_ord) AS before FROM y)
        SELECT company, q_ord, make_date(q_ord // 4, q_ord % 4 * 3 + 1, 1) AS start, last_day(make_date(q_ord // 4, q_ord % 4 * 3 + 3, 1)) AS "end", CASE WHEN q_ord % 4 = 0 THEN ytd ELSE round(ytd - before, 3) + 0.0 END AS value, q_ord % 4 > 0 AS derived FROM l WHERE n = q_ord % 4 + 1""",
    "growth_margin_deltas": f"""WITH {_ST}, m AS (SELECT company, q_ord, revenue, round((revenue - cost) / revenue * 100, 3) AS margin FROM st WHERE (company + q_ord) % 5 <> 0)
        SELECT m.company, m.q_ord, m.revenue, m.margin, CASE WHEN p.revenue <> 0 THEN round((m.revenue / p.revenue - 1) * 100, 3) END AS qoq, round(m.margin - y.margin, 3) AS margin_delta FROM m LEFT JOIN m p ON p.company = m.company AND p.q_ord = m.q_ord - 1 LEFT JOIN m y ON y.company = m.company AND y.q_ord = m.q_ord - 4""",
    "fx_adjusted_growth": f"""WITH {_YOY}, s AS (SELECT *, CASE WHEN q_ord % 7 <> 0 THEN 1 + q_ord % 5 / 10 END AS scale FROM g)
        SELECT s.company, s.q_ord, s.yoy, s.scale, CASE WHEN p.scale > 0 THEN coalesce(round(((1 + s.yoy / 100) * s.scale / p.scale - 1) * 100, 3), s.yoy) ELSE s.yoy END AS yoy_adjusted FROM s LEFT JOIN s p ON p.company = s.company AND p.q_ord = s.q_ord - 4""",
    "weighted_growth": f"""WITH {_SEG}, m AS (SELECT s.*, CASE WHEN p.value <> 0 THEN round((s.value / p.value - 1) * 100, 2) END AS yoy FROM seg s LEFT JOIN seg p ON p.company = s.company AND p.member = s.member AND p.q_ord = s.q_ord - 4)
        SELECT company, q_ord, member[1] AS parent, round(sum(value * yoy) / sum(value), 1) + 0.0 AS yoy FROM m GROUP BY 1, 2, 3""",
    "taxonomy_sum_or_max": """WITH l AS (SELECT l_suppkey AS company, CAST(l_linenumber AS BIGINT) AS q_ord, ['sales_marketing', 'sales_marketing', NULL, 'general_administrative', 'finance_expense', 'rnd', 'general_administrative', 'impairment', 'elephants', 'elephants'][l_orderkey % 10 + 1] AS taxonomy, l_quantity AS v FROM lineitem)
        SELECT company, q_ord, taxonomy, round(CASE WHEN taxonomy = 'elephants' THEN max(v) ELSE sum(v) END, 3) AS value, count(*) AS n_rows FROM l WHERE taxonomy IS NOT NULL GROUP BY 1, 2, 3""",
    "combined_labels": """WITH l AS (SELECT DISTINCT l_partkey AS company, ['Cloud and Devices', 'Cloud', 'Devices', 'Other Cloud', 'Consolidated Cloud', 'Games'][l_orderkey % 6 + 1] AS member FROM lineitem),
        a AS (SELECT company, list(member) AS ms FROM l GROUP BY 1)
        SELECT company, member, member = 'Cloud and Devices' AND len([x for x in ms if x IN ('Cloud', 'Devices', 'Other Cloud')]) >= 2 AS is_combined, member = 'Cloud' AND list_contains(ms, 'Other Cloud') AS has_other FROM l JOIN a USING (company)""",
    "generic_members": """WITH l AS (SELECT DISTINCT l_partkey AS company, ['ProductMember', 'ServiceMember', 'CloudMember', 'PhonesMember', 'OperatingSegmentsMember'][l_orderkey % 5 + 1] AS member FROM lineitem), a AS (SELECT company, list(member) AS ms FROM l GROUP BY 1)
        SELECT company, member, CASE member WHEN 'ProductMember' THEN 'Products' WHEN 'ServiceMember' THEN 'Services' ELSE replace(member, 'Member', '') END AS label FROM l JOIN a USING (company)
        WHERE member <> 'OperatingSegmentsMember' AND NOT (member = 'ProductMember' AND len([x for x in ms if x NOT IN ('ProductMember', 'ServiceMember')]) >= 2) AND NOT (member = 'ServiceMember' AND list_contains(ms, 'CloudMember'))""",
    "addable_taxonomy": f"WITH {_SPARSE} SELECT company, q_ord, count(*) FILTER (member NOT IN ('A', 'R')) = 0 AS addable FROM sps GROUP BY 1, 2",
    "layout_fit_band": f"""WITH {_SEG}, a AS (SELECT company, q_ord, member, greatest(value, 0) AS raw, count(*) OVER w AS n, sum(greatest(value, 0)) OVER w AS whole FROM seg WINDOW w AS (PARTITION BY company, q_ord)),
        b AS (SELECT *, CASE WHEN n > 1 THEN least(8.0::DOUBLE, greatest(399.0::DOUBLE / (n - 1), 0)) ELSE 0 END AS space FROM a), c AS (SELECT *, greatest(400.0::DOUBLE - space * (n - 1), 1) AS room FROM b), d AS (SELECT *, least(24.0::DOUBLE, room / n) AS floor FROM c),
        k AS (SELECT *, row_number() OVER w - 1 AS k, greatest(room - floor * (row_number() OVER w - 1), 0) / (whole - coalesce(sum(raw) OVER (PARTITION BY company, q_ord ORDER BY raw, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM d WINDOW w AS (PARTITION BY company, q_ord ORDER BY raw, member)),
        f AS (SELECT *, arg_min(rate, k) FILTER (raw * rate >= floor) OVER w AS free_rate, min(k) FILTER (raw * rate >= floor) OVER w AS free_k FROM k WINDOW w AS (PARTITION BY company, q_ord)), h AS (SELECT *, CASE WHEN k >= free_k THEN raw * free_rate ELSE floor END AS h0, row_number() OVER (PARTITION BY company, q_ord ORDER BY member) = n AS last FROM f),
        o AS (SELECT *, room - sum(h0) OVER (PARTITION BY company, q_ord) AS off FROM h), g AS (SELECT *, greatest(CASE WHEN last AND abs(off) > 0.01 THEN h0 + off ELSE h0 END, 1) AS h FROM o),
        s AS (SELECT *, coalesce(sum(h + space) OVER (PARTITION BY company, q_ord ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g) SELECT company, q_ord, member, round(start, 6) AS top, round(CASE WHEN last THEN 400.0 ELSE start + h END, 6) AS bottom FROM s""",
    "layout_boxes": f"""WITH {_SEG}, {_ST}, b AS (SELECT seg.company, seg.q_ord, member, greatest(value / revenue * 200, 1) AS tall, value / revenue * 400 AS center FROM seg JOIN st USING (company, q_ord)), t AS (SELECT *, greatest(least(center - tall / 2, 400 - tall), 0) AS wish FROM b),
        p AS (SELECT *, coalesce(sum(tall + 12) OVER (PARTITION BY company, q_ord ORDER BY wish, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS packed, row_number() OVER (PARTITION BY company, q_ord ORDER BY wish DESC, member DESC) = 1 AS last FROM t),
        s AS (SELECT *, max(wish - packed) OVER (PARTITION BY company, q_ord ORDER BY wish, member ROWS UNBOUNDED PRECEDING) AS shift FROM p), x AS (SELECT *, max(CASE WHEN last THEN packed + shift + tall END) OVER (PARTITION BY company, q_ord) > 400 AS beyond FROM s),
        m AS (SELECT *, packed + CASE WHEN beyond THEN min(CASE WHEN last THEN 400 - tall - packed ELSE shift END) OVER (PARTITION BY company, q_ord ORDER BY wish, member ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE shift END AS at0 FROM x),
        n AS (SELECT *, at0 + greatest(-min(at0) OVER (PARTITION BY company, q_ord), 0) AS at1 FROM m) SELECT company, q_ord, member, round(at1, 6) AS top, round(at1 + tall, 6) AS bottom FROM n""",
    "history_gap_fill": f"""WITH {_SPARSE}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY company, q_ord) AS share FROM sps),
        q AS (SELECT company, q_ord, coalesce(string_agg(member, '|' ORDER BY member) FILTER (member <> 'otherrevenue'), '') AS names, sum(value) AS total, max(revenue) AS revenue, count(*) AS n FROM s GROUP BY 1, 2),
        l AS (SELECT *, lag(names) OVER w AS a, lead(names) OVER w AS b, lag(q_ord) OVER w AS aq, lead(q_ord) OVER w AS bq, lag(n) OVER w AS an FROM q WINDOW w AS (PARTITION BY company ORDER BY q_ord)),
        g AS (SELECT *, greatest(revenue - total, 0) AS gap FROM l WHERE a = b AND a <> names AND an - n BETWEEN 1 AND 2),
        x AS (SELECT g.company, g.q_ord, p.member, g.gap, (p.share + f.share) / 2 AS w FROM g JOIN s p ON p.company = g.company AND p.q_ord = g.aq JOIN s f ON f.company = g.company AND f.q_ord = g.bq AND f.member = p.member
            WHERE gap > 0.12 AND NOT EXISTS (SELECT 1 FROM sps o WHERE o.company = g.company AND o.q_ord = g.q_ord AND o.member = p.member) AND NOT EXISTS (SELECT 1 FROM sps o WHERE o.company = g.company AND o.q_ord = g.q_ord AND NOT EXISTS (SELECT 1 FROM sps z WHERE z.company = g.company AND z.q_ord = g.aq AND z.member = o.member))),
        y AS (SELECT *, round(gap * w / sum(w) OVER (PARTITION BY company, q_ord), 3) AS v FROM x), z AS (SELECT company, q_ord, round(max(gap) - sum(v), 3) AS rest FROM y WHERE v > 0.02 GROUP BY 1, 2)
        SELECT company, q_ord, member, value, false AS filled FROM sps UNION ALL SELECT company, q_ord, member, v, true FROM y WHERE v > 0.02 UNION ALL SELECT company, q_ord, 'otherrevenue', rest, false FROM z WHERE rest > 0.03""",
}

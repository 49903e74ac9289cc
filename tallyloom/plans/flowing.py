"""Queries over flows and costs, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import flows
from tallyloom.plans.queries import _Q
from tallyloom.sources.tables import _money, _net, quarter_of, read

QUARTER = ["company", "q_ord"]


def _cents(c):
    return flows._rounded(c.cast("double") / 100000)


def supplier_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's quarter in hundreds of thousands, from lines' own fields; what a status or flag lacks in the quarter is null.

    Costs are those of finished lines, expenses those of returned ones, pretax income those of accepted ones, tax is lines'.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("company"), quarter_of("l_shipdate").alias("q_ord"), "l_returnflag", "l_linestatus", "l_quantity", _net().alias("net"), (_money("l_tax") * _money("l_extendedprice")).alias("tax"))
    of = lambda when: F.sum(F.when(when, F.col("net")))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    sums = lines.groupBy(*QUARTER).agg(F.sum("net").alias("revenue"), of((status == "F") & (flag != "N")).alias("cost"), of((flag == "R") & (status == "O")).alias("opex"), of((flag == "A") & (status == "F")).alias("pretax"), of((flag == "N") & (status == "O")).alias("net_income"), F.sum("tax").alias("tax"), of((status == "O") & (flag == "A")).alias("op_income"), of(F.col("l_quantity") > 47).alias("non_op"), F.count(F.lit(1)).alias("n"))
    null = F.lit(None).cast("double")
    odd = F.col("n") % 3 == 0
    return sums.select(
        *QUARTER, _cents(F.col("revenue")).alias("revenue"), F.when(~odd, _cents(F.col("cost"))).alias("cost"), null.alias("gross"), _cents(F.col("opex")).alias("opex"), F.when(F.col("n") % 4 != 0, _cents(F.col("op_income"))).alias("op_income"),
        null.alias("sgna"), null.alias("rnd"), null.alias("opex_sum"), _cents(F.col("pretax")).alias("pretax"), _cents(F.col("net_income")).alias("net"), _cents(F.when(F.col("n") % 5 == 0, -F.col("tax")).otherwise(F.col("tax"))).alias("tax"), F.when(F.col("n") % 2 == 0, -_cents(F.col("non_op"))).otherwise(_cents(F.col("non_op"))).alias("non_op"),
    )


def bridge_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = flows.snapshot(supplier_bridges(spark, sf_dir))
    items = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "|")
    return told.withColumns({"gains": items("gains"), "losses": items("losses")})


def bridge_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.bridge_flows(flows.snapshot(supplier_bridges(spark, sf_dir)))


def cost_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by type of part: returned lines' are given where there are five or more, else margins are, or traffic."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("company"), quarter_of("l_shipdate").alias("q_ord"), F.col("l_partkey").alias("p_partkey"), "l_returnflag", _net().alias("net"), "l_quantity")
    cells = lines.join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("member")), "p_partkey").groupBy(*QUARTER, "member").agg(F.sum("net").alias("net"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("net"))).alias("back"), F.count_if(F.col("l_returnflag") == "R").alias("n_back"), F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("n"))
    sums = cells.groupBy(*QUARTER).agg(F.sum("net").alias("net"), F.sum("n_back").alias("n_back"), F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))
    quarters = sums.select(*QUARTER, "n_back", flows._rounded(_cents(F.col("net")) * 0.6).alias("cost"), F.when(F.col("quantity") % 3 != 0, _cents(F.col("net") / 8)).alias("tac"), F.when(F.col("quantity") % 2 == 0, F.lit(1.25)).alias("other_cost"))
    given = cells.filter("back IS NOT NULL").join(quarters.filter("n_back >= 9").select(*QUARTER), QUARTER).select(*QUARTER, "member", _cents(F.col("back")).alias("value"))
    margin = F.when(F.col("quantity") % 7 != 0, (F.col("quantity") % 90).cast("double"))
    segments = cells.join(sums.filter("quantity % 5 <> 0").select(*QUARTER), QUARTER).select(*QUARTER, "member", _cents(F.col("net")).alias("value"), margin.alias("margin"))
    return flows.cost_cascade(quarters.drop("n_back"), [given], segments)


QUERIES = {f.__name__: f for f in (bridge_snapshots, bridge_flows, cost_cascade)}


def _r3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


def _c(x: str) -> str:
    return _r3(f"CAST({x} AS DOUBLE) / 100000")


_NET = "CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"
_SUM = f"sum({_NET}) FILTER ({{}})"
_BRIDGES = f"""b0 AS (SELECT CAST(l_suppkey AS BIGINT) AS company, {_Q.format('l_shipdate')} AS q_ord, sum({_NET}) AS revenue, {_SUM.format("l_linestatus = 'F' AND l_returnflag <> 'N'")} AS cost, {_SUM.format("l_returnflag = 'R' AND l_linestatus = 'O'")} AS opex,
        {_SUM.format("l_returnflag = 'A' AND l_linestatus = 'F'")} AS pretax, {_SUM.format("l_returnflag = 'N' AND l_linestatus = 'O'")} AS net, sum(CAST(l_tax AS DECIMAL(15, 2)) * CAST(l_extendedprice AS DECIMAL(15, 2))) AS tax, {_SUM.format("l_linestatus = 'O' AND l_returnflag = 'A'")} AS op_income, {_SUM.format('l_quantity > 47')} AS non_op, count(*) AS n FROM lineitem GROUP BY 1, 2),
    b AS (SELECT company, q_ord, {_c('revenue')} AS revenue, CASE WHEN n % 3 <> 0 THEN {_c('cost')} END AS cost, {_c('opex')} AS opex, CASE WHEN n % 4 <> 0 THEN {_c('op_income')} END AS op_income, {_c('pretax')} AS pretax, {_c('net')} AS net,
        {_c('CASE WHEN n % 5 = 0 THEN -tax ELSE tax END')} AS tax, CASE WHEN n % 2 = 0 THEN -{_c('non_op')} ELSE {_c('non_op')} END AS non_op FROM b0),
    g AS (SELECT * EXCLUDE (cost), coalesce(revenue - cost, op_income + opex) AS gross, coalesce(cost, greatest(revenue - (op_income + opex), CASE WHEN op_income + opex IS NOT NULL THEN 0 END), CASE WHEN op_income + opex IS NULL THEN NULL END) AS cost0 FROM b),
    f AS (SELECT * EXCLUDE (cost0), cost0 AS cost, gross IS NOT NULL AND cost0 IS NOT NULL AS full_, coalesce(pretax, net + tax) AS source, coalesce(op_income, coalesce(pretax, net + tax) - non_op, net + coalesce(tax, 0) - coalesce(non_op, 0)) AS base FROM g),
    o AS (SELECT *, greatest(opex, 0) AS ox, CASE WHEN base IS NOT NULL THEN greatest(gross - base, 0) END AS bridge FROM f),
    o1 AS (SELECT *, CASE WHEN opex IS NULL THEN NULL ELSE ox END AS x, coalesce(base IS NULL AND ox > gross + 0.25 AND ox <= greatest(revenue, 0) + greatest(0.35, greatest(revenue, 0) * 0.02) AND greatest(ox - greatest(cost, 0), 0) <= gross + greatest(0.35, gross * 0.04) AND opex IS NOT NULL, false) AS totals FROM o),
    o2 AS (SELECT *, abs(x - bridge) AS off FROM o1),
    o3 AS (SELECT *, CASE WHEN bridge > 0.05 THEN off / bridge ELSE off END AS rel FROM o2),
    o4 AS (SELECT *, coalesce(NOT x > gross + 0.25 AND NOT x > bridge + greatest(0.02, bridge * 0.002) AND (off <= 0.25 OR rel <= 0.08), false) AS fits, coalesce(x > revenue + 0.25, false) OR coalesce(x > gross + 0.25, false) AS much FROM o3),
    s AS (SELECT *, round(CASE WHEN totals THEN greatest(revenue, 0) - x ELSE base END, 3) + 0.0 AS op, round(CASE WHEN totals THEN greatest(x - greatest(cost, 0), 0) WHEN x IS NULL THEN bridge WHEN bridge IS NULL THEN CASE WHEN much THEN 0 ELSE x END WHEN fits THEN x ELSE bridge END, 3) + 0.0 AS ope FROM o4),
    p AS (SELECT *, net + tax AS by_tax, op + non_op AS by_stage FROM s),
    p1 AS (SELECT *, round(CASE WHEN pretax IS NOT NULL AND (coalesce(abs(pretax - by_tax) <= greatest(0.25, abs(by_tax) * 0.05), false) OR coalesce(abs(pretax - by_stage) <= greatest(0.25, abs(by_stage) * 0.05), false)) THEN pretax ELSE coalesce(by_tax, by_stage, pretax) END, 3) + 0.0 AS pt FROM p),
    p2 AS (SELECT *, pt - op AS rest FROM p1),
    p3 AS (SELECT *, non_op IS NOT NULL AND (rest IS NULL OR abs(non_op - rest) <= 0.25 OR CASE WHEN abs(rest) > 0.05 THEN abs(non_op - rest) <= 0.08 * abs(rest) ELSE abs(non_op - rest) <= 0.08 END) AS keep FROM p2),
    q AS (SELECT *, round(CASE WHEN keep THEN non_op ELSE rest END, 3) + 0.0 AS nr, NOT keep AND rest IS NOT NULL AS residual FROM p3),
    t AS (SELECT company, q_ord, CASE WHEN full_ THEN 'full' ELSE 'revenue-only' END AS coverage, revenue, full_, gross AS gross0, CASE WHEN full_ THEN gross END AS gross, CASE WHEN full_ THEN cost END AS cost, CASE WHEN full_ THEN op END AS operating, CASE WHEN full_ THEN ope END AS ope,
        CASE WHEN full_ AND abs(nr) > 0.05 THEN {_r3('nr')} END AS non_operating, CASE WHEN full_ THEN pt ELSE source END AS pretax, net, tax, residual FROM q),
    u AS (SELECT *, coalesce(CASE WHEN operating < -0.02 THEN -operating END, 0) AS overflow FROM t),
    w AS (SELECT *, CASE WHEN full_ THEN CASE WHEN overflow > 0 THEN least(greatest(coalesce(ope, 0), 0), greatest(gross, 0)) ELSE greatest(coalesce(ope, 0), 0) END END AS opex,
        list_filter([CASE WHEN full_ AND non_operating > 0.05 THEN {{name: CASE WHEN residual THEN 'Other pretax gain' ELSE 'Non-operating gain' END, value: {_r3('non_operating')}}} END, CASE WHEN full_ AND tax < -0.05 THEN {{name: 'Tax benefit', value: {_r3('-tax')}}} END], lambda x: x IS NOT NULL) AS up,
        list_filter([CASE WHEN full_ AND overflow > 0.05 THEN {{name: 'Operating loss overflow', value: {_r3('overflow')}}} END, CASE WHEN full_ AND non_operating < -0.05 THEN {{name: CASE WHEN residual THEN 'Other pretax expense' ELSE 'Non-operating' END, value: {_r3('-non_operating')}}} END,
            CASE WHEN full_ AND tax > 0.05 THEN {{name: 'Tax', value: {_r3('tax')}}} END], lambda x: x IS NOT NULL) AS down FROM u),
    x AS (SELECT *, CASE WHEN full_ THEN {_r3("net - (CASE WHEN overflow > 0 THEN 0 ELSE coalesce(operating, 0) END + coalesce(list_sum(list_transform(up, lambda i: i.value)), 0) - coalesce(list_sum(list_transform(down, lambda i: i.value)), 0))")} END AS nres FROM w),
    y AS (SELECT *, coalesce(abs(nres) > greatest(0.045, abs(net) * 0.005), false) AS beyond FROM x),
    z AS (SELECT *, CASE WHEN beyond AND nres > 0 THEN list_append(up, {{name: 'Other net gain', value: abs(nres)}}) ELSE up END AS gains, CASE WHEN beyond AND nres < 0 THEN list_append(down, {{name: 'Other net expense', value: abs(nres)}}) ELSE down END AS losses FROM y)"""
_NAMES = "array_to_string(list_transform({}, lambda i: i.name), '|')"
_MARGIN = lambda x: f"CASE WHEN revenue <> 0 THEN {_r3(f'{x} / revenue * 100')} END"
_COSTS = f"""l AS (SELECT CAST(l_suppkey AS BIGINT) AS company, {_Q.format('l_shipdate')} AS q_ord, p_type AS member, l_returnflag = 'R' AS back, {_NET} AS net, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey),
    c AS (SELECT company, q_ord, member, sum(net) AS net, sum(net) FILTER (back) AS back, count(*) FILTER (back) AS n_back, CAST(sum(quantity) AS BIGINT) AS quantity FROM l GROUP BY 1, 2, 3),
    s AS (SELECT company, q_ord, sum(net) AS net, sum(n_back) AS n_back, CAST(sum(quantity) AS BIGINT) AS quantity FROM c GROUP BY 1, 2),
    q AS (SELECT company, q_ord, n_back, quantity, {_r3(_c('net') + ' * 0.6::DOUBLE')} AS cost, CASE WHEN quantity % 3 <> 0 THEN {_r3('CAST(net / 8 AS DOUBLE) / 100000')} END AS tac, CASE WHEN quantity % 2 = 0 THEN 1.25::DOUBLE END AS other FROM s),
    d AS (SELECT c.company, c.q_ord, member, {_c('back')} AS v, cost AS t, greatest(0.08, cost * 0.01) AS tol FROM c JOIN q USING (company, q_ord) WHERE back IS NOT NULL AND q.n_back >= 9 AND cost > 0.05),
    d1 AS (SELECT *, count(*) OVER k AS n, sum(v) OVER k AS total, max(v) OVER k AS top, row_number() OVER (PARTITION BY company, q_ord ORDER BY member) AS i FROM d WINDOW k AS (PARTITION BY company, q_ord)),
    d2 AS (SELECT *, top <= t + tol AND total <= t + tol AS fits, round(v * t / total, 3) AS scaled FROM d1),
    d3 AS (SELECT *, coalesce(sum(scaled) OVER (PARTITION BY company, q_ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d2),
    g AS (SELECT company, q_ord, member, CASE WHEN fits THEN round(v, 3) WHEN n = 1 THEN round(least(v, t), 3) WHEN i = n THEN round(greatest(t - before, 0), 3) ELSE scaled END AS value FROM d3
        UNION ALL SELECT company, q_ord, 'residual', round(t - total, 3) FROM d3 WHERE fits AND i = 1 AND t - total > tol),
    m AS (SELECT c.company, c.q_ord, member, {_c('c.net')} AS value, CASE WHEN c.quantity % 7 <> 0 THEN CAST(c.quantity % 90 AS DOUBLE) END AS margin, q.cost FROM c JOIN q USING (company, q_ord) WHERE q.quantity % 5 <> 0),
    m1 AS (SELECT *, CASE WHEN margin IS NOT NULL THEN value * (1 - margin / 100) END AS own FROM m WHERE value > 0.02 AND cost > 0.02),
    m2 AS (SELECT *, count(*) FILTER (margin IS NULL) OVER k AS open, coalesce(sum(own) OVER k, 0) AS total FROM m1 WINDOW k AS (PARTITION BY company, q_ord)),
    m3 AS (SELECT *, CASE WHEN margin IS NOT NULL THEN {_r3('own')} WHEN open = 1 THEN {_r3('greatest(cost - total, 0)')} END AS part FROM m2),
    m4 AS (SELECT *, cost / sum(part) OVER (PARTITION BY company, q_ord) AS scale FROM m3),
    n AS (SELECT company, q_ord, member, CASE WHEN open = 0 AND abs(scale - 1) > 0.015 THEN {_r3('part * scale')} ELSE part END AS value FROM m4),
    r AS (SELECT company, q_ord, unnest([{{member: 'Other', value: {_r3('coalesce(other, greatest(coalesce(cost, 0) - tac, 0))')}}}, {{member: 'TAC', value: {_r3('tac')}}}], recursive := true) FROM q WHERE tac > 0.02),
    a AS (SELECT 0 AS tier, 'given 0' AS source, company, q_ord, member, value FROM g WHERE value > 0.02 UNION ALL SELECT 1, 'profile', company, q_ord, member, value FROM n WHERE value > 0.02 UNION ALL SELECT 2, 'funnel', company, q_ord, member, value FROM r WHERE value > 0.02)"""
ORACLE_SQL = {
    "bridge_snapshots": f"""WITH {_BRIDGES} SELECT company, q_ord, coverage, revenue, gross, cost, operating, opex, overflow, pretax, non_operating, net, {_MARGIN('gross')} AS gross_margin, {_MARGIN('operating')} AS operating_margin, {_MARGIN('net')} AS net_margin,
        {_NAMES.format('gains')} AS gains, {_NAMES.format('losses')} AS losses FROM z""",
    "bridge_flows": f"""WITH {_BRIDGES}, e AS (SELECT company, q_ord, 'revenue' AS source, 'reported' AS target, revenue AS value FROM z WHERE NOT full_ UNION ALL SELECT company, q_ord, 'revenue', 'gross', greatest(gross, 0) FROM z WHERE full_ UNION ALL SELECT company, q_ord, 'revenue', 'cost', cost FROM z WHERE full_
        UNION ALL SELECT company, q_ord, 'gross', 'operating', operating FROM z WHERE full_ UNION ALL SELECT company, q_ord, 'gross', 'opex', opex FROM z WHERE full_ UNION ALL SELECT company, q_ord, 'operating', 'net', CASE WHEN net IS NULL THEN least(operating, 0) ELSE least(operating, greatest(net, 0)) END FROM z WHERE full_ AND operating IS NOT NULL
        UNION ALL SELECT company, q_ord, i.name, 'net', i.value FROM (SELECT company, q_ord, unnest(gains) AS i FROM z) UNION ALL SELECT company, q_ord, CASE WHEN operating > 0.02 THEN 'operating' ELSE 'outside' END, i.name, i.value FROM (SELECT company, q_ord, operating, unnest(losses) AS i FROM z)) SELECT * FROM e WHERE value > 0.02""",
    "cost_cascade": f"WITH {_COSTS} SELECT company, q_ord, source, member, value FROM a QUALIFY tier = min(tier) OVER (PARTITION BY company, q_ord)",
}

"""A quarter's flow from revenue to net income, and what its costs are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.bridge import operating_stage, pretax_stage
from tallyloom.operators.repairs import QUARTER, reconcile_to_total

#: Names of what is added to and taken from operating profit, by their cause.
GAINS = {"residual": "Other pretax gain", "non_operating": "Non-operating gain", "tax": "Tax benefit", "net": "Other net gain"}
LOSSES = {"overflow": "Operating loss overflow", "residual": "Other pretax expense", "non_operating": "Non-operating", "tax": "Tax", "net": "Other net expense"}


def _rounded(x: Column) -> Column:
    """To thousandths, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def snapshot(df: DataFrame) -> DataFrame:
    """a quarter's stages (revenue, cost, gross, opex, op_income, sgna, rnd, opex_sum, pretax, net, tax, non_op).

    Gross profit is given, or revenue less cost, or operating income and expenses; costs are given, or what gross profit leaves
    of the revenue. With both, coverage is `full`: operating and pretax stages are resolved (F28), where an operating income that
    isn't given is pretax less non-operating income, or net income and tax less that. Else it is `revenue-only`, without stages
    below. A loss of over 0.02 is an overflow: only expenses that the gross profit covers are shown. Non-operating income counts
    above 0.05. What net income differs from the flow by, beyond 0.045 and five thousandths, is a gain or loss of its own.
    """
    c = F.col
    gross = F.coalesce("gross", c("revenue") - c("cost"), c("op_income") + c("opex"))
    df = df.withColumn("gross", gross).withColumn("cost", F.coalesce("cost", F.greatest(c("revenue") - c("gross"), F.lit(0.0))))
    df = df.withColumn("coverage", F.when(c("gross").isNotNull() & c("cost").isNotNull(), "full").otherwise("revenue-only"))
    full = c("coverage") == "full"
    pretax = F.coalesce("pretax", c("net") + c("tax"))
    base = F.coalesce("op_income", pretax - c("non_op"), c("net") + _zero("tax") - _zero("non_op"))
    staged = pretax_stage(operating_stage(df.withColumn("source_pretax", pretax).withColumn("op_income", base)))
    only_full = lambda x: F.when(full, x)
    kept = F.when(F.abs("non_op_resolved") > 0.05, _rounded(c("non_op_resolved")))
    out = staged.withColumns({"operating": only_full(c("op_resolved")), "opex_full": only_full(c("opex_resolved")), "non_operating": only_full(kept), "pretax_shown": F.when(full, c("pretax_resolved")).otherwise(c("source_pretax"))})
    overflow = F.coalesce(F.when(c("operating") < -0.02, -c("operating")), F.lit(0.0))
    out = out.withColumn("overflow", overflow)
    covered = F.greatest(F.coalesce("opex_full", F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("opex_shown", only_full(F.when(c("overflow") > 0, F.least(covered, F.greatest("gross", F.lit(0.0)))).otherwise(covered)))
    part = lambda name, value, when: F.when(when, F.struct(name.alias("name"), _rounded(value).alias("value")))
    label = lambda names: F.when(c("residual"), names["residual"]).otherwise(names["non_operating"])
    gains = [part(label(GAINS), c("non_operating"), full & (c("non_operating") > 0.05)), part(F.lit(GAINS["tax"]), -c("tax"), full & (c("tax") < -0.05))]
    losses = [part(F.lit(LOSSES["overflow"]), c("overflow"), full & (c("overflow") > 0.05)), part(label(LOSSES), -c("non_operating"), full & (c("non_operating") < -0.05)), part(F.lit(LOSSES["tax"]), c("tax"), full & (c("tax") > 0.05))]
    listed = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    out = out.withColumns({"gains": listed(gains), "losses": listed(losses)})
    sum_of = lambda items: F.aggregate(items, F.lit(0.0), lambda a, x: a + x["value"])
    told = F.when(c("overflow") > 0, 0.0).otherwise(_zero("operating")) + sum_of("gains") - sum_of("losses")
    out = out.withColumn("net_residual", only_full(_rounded(c("net") - told)))
    beyond = F.abs("net_residual") > F.greatest(F.lit(0.045), F.abs("net") * 0.005)
    more = lambda items, when, name: F.when(F.coalesce(beyond & when, F.lit(False)), F.concat(items, F.array(F.struct(F.lit(name).alias("name"), F.abs("net_residual").alias("value"))))).otherwise(c(items))
    out = out.withColumns({"gains": more("gains", c("net_residual") > 0, GAINS["net"]), "losses": more("losses", c("net_residual") < 0, LOSSES["net"])})
    margin = lambda x: F.when(c("revenue") != 0, _rounded(x / c("revenue") * 100))
    return out.select(
        *QUARTER, "coverage", "revenue", only_full(c("gross")).alias("gross"), only_full(c("cost")).alias("cost"), "operating", F.col("opex_shown").alias("opex"), "overflow", F.col("pretax_shown").alias("pretax"), "non_operating", "net",
        only_full(margin(c("gross"))).alias("gross_margin"), margin(c("operating")).alias("operating_margin"), margin(c("net")).alias("net_margin"), "gains", "losses",
    )


def bridge_flows(snapshots: DataFrame) -> DataFrame:
    """company, q_ord, source, target, value of each flow of over 0.02: what comes from a stage goes on or branches off.

    Of a quarter that covers its revenue only there is the revenue alone. Gains come to net income from outside; losses leave
    it, or come from outside where there is no operating profit to leave.
    """
    c, full = F.col, F.col("coverage") == "full"
    flow = lambda source, target, value, when: F.when(when & (value > 0.02), F.struct(source.alias("source"), target.alias("target"), value.alias("value")))
    lit = F.lit
    fixed = [
        flow(lit("revenue"), lit("reported"), c("revenue"), ~full), flow(lit("revenue"), lit("gross"), F.greatest("gross", lit(0.0)), full), flow(lit("revenue"), lit("cost"), c("cost"), full),
        flow(lit("gross"), lit("operating"), c("operating"), full), flow(lit("gross"), lit("opex"), c("opex"), full), flow(lit("operating"), lit("net"), F.least("operating", F.greatest("net", lit(0.0))), full),
    ]
    gains = F.transform("gains", lambda x: F.struct(x["name"].alias("source"), lit("net").alias("target"), x["value"].alias("value")))
    losses = F.transform("losses", lambda x: F.struct(F.when(c("operating") > 0.02, "operating").otherwise("outside").alias("source"), x["name"].alias("target"), x["value"].alias("value")))
    every = F.filter(F.concat(F.array(*fixed), gains, losses), lambda x: x["value"] > 0.02)
    return snapshots.select(*QUARTER, F.inline(every))


def profile_costs(segments: DataFrame) -> DataFrame:
    """costs by segment from margins (company, q_ord, member, value, margin in hundredths, cost): member, value.

    A segment with a margin (held between -20 and 99.5) costs its revenue less that. Of the others one alone takes what is left
    of the quarter's cost, and several take none. With all margins given, costs that are off by over 1.5 hundredths are scaled to
    the quarter's. Segments and costs of 0.02 or less don't count.
    """
    whole = Window.partitionBy(*QUARTER)
    used = segments.filter((F.col("value") > 0.02) & (F.col("cost") > 0.02))
    priced = used.withColumn("_own", F.col("value") * (1 - F.least(F.greatest("margin", F.lit(-20.0)), F.lit(99.5)) / 100))
    priced = priced.withColumn("_own", F.when(F.col("margin").isNotNull(), F.col("_own"))).withColumns({"_open": F.count_if(F.col("margin").isNull()).over(whole), "_sum": F.coalesce(F.sum(F.col("_own").cast("decimal(30,9)")).over(whole).cast("double"), F.lit(0.0))})  # decimals, as sums of doubles depend on their order
    parts = F.when(F.col("margin").isNotNull(), _rounded(F.col("_own"))).when(F.col("_open") == 1, _rounded(F.greatest(F.col("cost") - F.col("_sum"), F.lit(0.0))))
    shown = priced.withColumn("_part", parts).withColumn("_scale", F.col("cost") / F.sum(F.col("_part").cast("decimal(30,3)")).over(whole).cast("double"))
    scaled = F.when((F.col("_open") == 0) & (F.abs(F.col("_scale") - 1) > 0.015), _rounded(F.col("_part") * F.col("_scale"))).otherwise(F.col("_part"))
    return shown.select(*QUARTER, "member", scaled.alias("value")).filter(F.col("value") > 0.02)


def funnel_costs(quarters: DataFrame) -> DataFrame:
    """traffic acquisition and other costs (company, q_ord, tac, other_cost, cost); other costs are what is left, if not given."""
    told = quarters.filter(F.col("tac") > 0.02)
    other = F.coalesce("other_cost", F.greatest(_zero("cost") - F.col("tac"), F.lit(0.0)))
    cells = F.array(F.struct(F.lit("Other").alias("member"), _rounded(other).alias("value")), F.struct(F.lit("TAC").alias("member"), _rounded(F.col("tac")).alias("value")))
    return told.select(*QUARTER, F.inline(cells)).filter(F.col("value") > 0.02)


def cost_cascade(quarters: DataFrame, given: list[DataFrame], segments: DataFrame) -> DataFrame:
    """company, q_ord, source, member, value: the first of a quarter's breakdowns that has rows.

    `given` (company, q_ord, member, value) come first, in order, fitted to the cost (F12); then costs from margins, then those of
    a funnel.  quarters: company, q_ord, cost, tac, other_cost; segments: as profile_costs has them, without the cost.
    """
    totals = quarters.select(*QUARTER, F.col("cost").alias("total"))
    tiers = [(f"given {i}", reconcile_to_total(rows.join(totals, QUARTER).select(*QUARTER, "member", "value", "total")).withColumnRenamed("fitted", "value")) for i, rows in enumerate(given)]
    tiers.append(("profile", profile_costs(segments.join(quarters.select(*QUARTER, "cost"), QUARTER))))
    tiers.append(("funnel", funnel_costs(quarters)))
    all_rows = reduce(DataFrame.unionByName, (rows.select(*QUARTER, F.lit(i).alias("_tier"), F.lit(name).alias("source"), "member", "value") for i, (name, rows) in enumerate(tiers)))
    return all_rows.withColumn("_first", F.min("_tier").over(Window.partitionBy(*QUARTER))).filter(F.col("_tier") == F.col("_first")).drop("_tier", "_first")

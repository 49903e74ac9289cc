"""Repairing breakdowns: residuals, fitting, unit slips, outliers, missing members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.breakdown import suspicious

QUARTER = ["company", "q_ord"]
REST = "otherrevenue"


def _whole() -> Window:
    return Window.partitionBy(*QUARTER)


def scale_or_residual(df: DataFrame, least: float = 0.36) -> DataFrame:
    """members against the quarter's total. Below `least` of it the quarter goes; above 1.12 members are scaled down;
    below 0.94 with more than 0.03 left, the rest becomes (or joins) the member otherrevenue."""
    share = F.sum("value").over(_whole()) / F.col("total")
    mode = F.when(~(F.coalesce(F.col("total"), F.lit(0.0)) > 0.02), "none").when(share < least, "coverage-too-low").when(share > 1.12, "scaled-down").when((share < 0.94) & (F.col("total") * (1 - share) > 0.03), "residual-added").otherwise("none")
    rows = df.withColumn("_share", share).withColumn("mode", mode).filter(F.col("mode") != "coverage-too-low")
    fitted = rows.withColumn("value", F.when(F.col("mode") == "scaled-down", F.round(F.col("value") / F.col("_share"), 3)).otherwise(F.col("value")))
    left = rows.filter(F.col("mode") == "residual-added").groupBy(*QUARTER, "total", "mode").agg(F.sum("value").alias("_sum"))
    rest = left.select(*QUARTER, F.lit(REST).alias("member"), F.round(F.col("total") - F.col("_sum"), 3).alias("value"), "mode")
    both = fitted.select(*QUARTER, "member", "value", "mode").unionByName(rest)
    return both.groupBy(*QUARTER, "member").agg(F.round(F.sum("value"), 3).alias("value"), F.max("mode").alias("mode"))


def reconcile_to_total(df: DataFrame, base: float = 0.08, relative: float = 0.01) -> DataFrame:
    """members fitted to the total, within a tolerance of `base` or `relative` of it.

    No total: as they are. A total of 0.05 or less: none. Members that fit get a residual row where the rest is past the
    tolerance; a single one is cut to the total; others are scaled, the last (by name) taking what is left. Rows of 0.02 or
    less go. Negative values count as 0.
    """
    order = _whole().orderBy("member")
    t, v = F.col("total"), F.col("_v")
    tolerance = F.greatest(F.lit(base), t * relative)
    rows = df.withColumn("_v", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(_whole())).withColumn("_sum", F.sum(F.col("_v").cast("decimal(30,9)")).over(_whole()).cast("double")).withColumn("_max", F.max("_v").over(_whole())).withColumn("_at", F.row_number().over(order))  # decimals, as sums of doubles depend on their order
    rows = rows.withColumn("_fits", (F.col("_max") <= t + tolerance) & (F.col("_sum") <= t + tolerance))
    scaled = F.round(v * t / F.col("_sum"), 3)
    rows = rows.withColumn("_scaled", F.when(F.col("_sum") > 0.0001, scaled))
    before = F.coalesce(F.sum("_scaled").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_before", before)
    fitted = F.when(F.col("_fits"), F.round(v, 3)).when(F.col("_n") == 1, F.round(F.least(v, t), 3)).when(F.col("_at") == F.col("_n"), F.round(F.greatest(t - F.col("_before"), F.lit(0.0)), 3)).otherwise(F.col("_scaled"))
    members = rows.filter(t.isNull() | (t > 0.05)).withColumn("fitted", F.when(t.isNull(), F.col("value")).otherwise(fitted)).filter(t.isNull() | (F.col("fitted") > 0.02))
    left = t - F.col("_sum")
    rest = rows.filter((t > 0.05) & F.col("_fits") & (F.col("_at") == 1) & (left > tolerance)).select(*QUARTER, F.lit("residual").alias("member"), F.round(left, 3).alias("fitted"))
    return members.select(*QUARTER, "member", "fitted").unionByName(rest)


def raw_millions(df: DataFrame) -> DataFrame:
    """a quarter whose largest member and sum are over 8 times the revenue, and the largest over 500, came in thousands more: divide."""
    limit = F.col("revenue") * 8
    slipped = (F.col("revenue") > 0) & (F.max("value").over(_whole()) > limit) & (F.sum("value").over(_whole()) > limit) & (F.max("value").over(_whole()) > 500)
    return df.withColumn("slipped", F.coalesce(slipped, F.lit(False))).withColumn("value", F.when(F.col("slipped"), F.round(F.col("value") / 1000, 3)).otherwise(F.col("value")))


def roll_up(df: DataFrame, parent: str, children: list[str]) -> DataFrame:
    """where all children are present and sum to over 0.02, they become the parent; a parent given explicitly keeps its value
    if that is 0.82 to 1.18 of the children's sum."""
    child = F.col("member").isin(*children)
    sums = df.filter(child | (F.col("member") == parent)).groupBy(*QUARTER).agg(F.count_if(child).alias("_n"), F.sum(F.when(child, F.col("value"))).alias("_sum"), F.max(F.when(F.col("member") == parent, F.col("value"))).alias("_own"))
    full = sums.filter((F.col("_n") == len(children)) & (F.col("_sum") > 0.02))
    value = F.when(F.col("_own").between(F.col("_sum") * 0.82, F.col("_sum") * 1.18), F.col("_own")).otherwise(F.round("_sum", 3))
    kept = df.join(full.select(*QUARTER, F.lit(True).alias("_full")), QUARTER, "left").filter(F.col("_full").isNull() | ~F.col("member").isin(*children, parent))
    return kept.select(*QUARTER, "member", "value").unionByName(full.select(*QUARTER, F.lit(parent).alias("member"), value.alias("value")))


def from_shares(df: DataFrame) -> DataFrame:
    """positive shares normalised and applied to the total (3 digits); a rest of over 0.004 goes to the first member by name.

    Quarters with a total of 0.02 or less, or shares of 0.000001 or less in all, give no rows.
    """
    shares = df.filter(F.col("share") > 0).withColumn("_sum", F.sum("share").over(_whole())).filter((F.col("_sum") > 0.000001) & (F.col("total") > 0.02))
    valued = shares.withColumn("_value", F.round(F.col("total") * F.col("share") / F.col("_sum"), 3))
    rest = F.round(F.col("total") - F.sum("_value").over(_whole()), 3)
    first = F.row_number().over(_whole().orderBy("member")) == 1
    return valued.select(*QUARTER, "member", F.when(first & (F.abs(rest) > 0.004), F.round(F.col("_value") + rest, 3)).otherwise(F.col("_value")).alias("value"))


def _median(c: Column) -> Column:
    return F.median(c)


def q4_outliers(statements: DataFrame, members: DataFrame) -> DataFrame:
    """fourth quarters that hold the whole year, 2.6 times the median of the year's other three or more.

    If members stayed in line (1.6 times at most) and revenue is 1.8 times their sum or more, revenue becomes that sum. Else, if
    at least two members grew by a like factor (median 2.6 to 5.4, spread at most 1.8) over the third quarter, revenue is divided
    by 4 (median 3.3 to 4.7) or by the median. Gives company, q_ord, revenue, factor (null if not divided) and flag.
    """
    year = F.floor(F.col("q_ord") / 4).alias("_year")
    place = F.col("q_ord") % 4
    by_year = statements.groupBy("company", year).agg(_median(F.when(place < 3, F.col("revenue"))).alias("_base"), F.min(F.when(place < 3, F.col("revenue"))).alias("_least"), F.count_if(place < 3).alias("_n"), F.max(F.when(place == 3, F.col("revenue"))).alias("_q4"))
    high = by_year.filter((F.col("_n") == 3) & (F.col("_least") > 0) & (F.col("_q4") / F.col("_base") >= 2.6))
    sums = members.groupBy("company", "q_ord").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("_s")).filter(F.col("_m") >= 2)
    by_members = sums.groupBy("company", year).agg(_median(F.when((place < 3) & (F.col("_s") > 0), F.col("_s"))).alias("_base_s"), F.max(F.when(place == 3, F.col("_s"))).alias("_q4_s"), F.count_if(place == 2).alias("_has_q3"), F.count_if(place == 3).alias("_has_q4"))
    grown = members.filter(place >= 2).groupBy("company", year, "member").agg(F.max(F.when(place == 2, F.col("value"))).alias("_v3"), F.max(F.when(place == 3, F.col("value"))).alias("_v4")).filter((F.col("_v3") > 0.05) & (F.col("_v4") > 0.05))
    ratio = F.col("_v4") / F.col("_v3")
    factors = grown.groupBy("company", "_year").agg(F.count(F.lit(1)).alias("_k"), _median(ratio).alias("_mid"), (F.max(ratio) - F.min(ratio)).alias("_spread"))
    joined = high.join(by_members.filter(F.col("_has_q4") > 0), ["company", "_year"]).join(factors, ["company", "_year"], "left")
    aligned = (F.col("_base_s") > 0) & (F.col("_q4_s") / F.col("_base_s") <= 1.6) & (F.col("_q4") / F.col("_q4_s") >= 1.8)
    like = (F.col("_has_q3") > 0) & (F.col("_k") >= 2) & F.col("_mid").between(2.6, 5.4) & (F.col("_spread") <= 1.8)
    factor = F.when(F.col("_mid").between(3.3, 4.7), 4.0).otherwise(F.round("_mid", 3))
    flag = F.when(aligned, "aligned-to-members").when(like, "annualised")
    found = joined.select("company", (F.col("_year") * 4 + 3).alias("q_ord"), flag.alias("flag"), F.when(~F.coalesce(aligned, F.lit(False)) & like, factor).alias("factor"), F.round("_q4_s", 3).alias("_to"))
    both = statements.select("company", "q_ord", "revenue").join(found.filter(F.col("flag").isNotNull()), ["company", "q_ord"], "left")
    revenue = F.when(F.col("flag") == "aligned-to-members", F.col("_to")).when(F.col("flag") == "annualised", F.round(F.col("revenue") / F.col("factor"), 3)).otherwise(F.col("revenue"))
    return both.select("company", "q_ord", revenue.alias("revenue"), "factor", "flag")


def _snapshots(df: DataFrame) -> DataFrame:
    """Quarters with their members as a map, their sum and its share of the revenue."""
    rows = df.filter((F.col("revenue") > 0) & (F.col("value") > 0)).groupBy(*QUARTER, "revenue", "member").agg(F.max("value").alias("value"))
    sets = rows.groupBy(*QUARTER, "revenue").agg(F.round(F.sum("value"), 3).alias("sum"), F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("members"))
    return sets.withColumn("coverage", F.col("sum") / F.col("revenue"))


def impute_member(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The one member a quarter lacks against a template quarter of the company, with the residual as its value.

    The quarter covers less than 0.72 of its revenue with two members or more, and the residual is over max(0.2, 10 %) and 0.25 to
    0.92 of the revenue. A template covers 0.82 to 1.22, holds all the quarter's members and one more that is allowed, that two
    templates or more hold, that is 0.12 of the template's sum or more, and whose share there is 1/2.4 to 1/0.45 of the
    residual's. The template with the least 10 * distance + 6 * |1 - ratio| + 5 * |coverage - 1| counts, the earliest of equals.
    Companies with fewer than three quarters of two members or more are left alone. Quarters meet the templates of their own
    company only, one row for each quarter.
    """
    sets = _snapshots(df).filter(F.size("members") >= 2).withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("company"))).filter(F.col("_many") >= 3)
    residual = F.round(F.col("revenue") - F.col("sum"), 3)
    sparse = sets.filter((F.col("coverage") < 0.72) & (residual > F.greatest(F.lit(0.2), F.col("revenue") * 0.1)) & (residual / F.col("revenue")).between(0.25, 0.92)).select(*QUARTER, F.map_keys("members").alias("_have"), residual.alias("value"), (residual / F.col("revenue")).alias("_share"))
    usable = sets.filter(F.col("coverage").between(0.82, 1.22))
    offered = usable.select("company", F.col("q_ord").alias("template"), F.col("sum").alias("_sum"), F.col("coverage").alias("_coverage"), F.map_keys("members").alias("_keys"), F.explode("members").alias("member", "_v"))
    support = Window.partitionBy("company", "member")
    offered = offered.withColumn("_support", F.count(F.lit(1)).over(support)).filter(F.col("member").isin(*allowed) & (F.col("_support") >= 2) & (F.col("_v") / F.col("_sum") >= 0.12))
    both = sparse.join(offered, "company").filter((F.size("_keys") == F.size("_have") + 1) & (F.size(F.array_except("_have", "_keys")) == 0) & ~F.array_contains("_have", F.col("member")))
    ratio = F.col("_share") / (F.col("_v") / F.col("_sum"))
    score = F.round(F.abs(F.col("q_ord") - F.col("template")) * 10 + F.abs(1 - ratio) * 6 + F.abs(F.col("_coverage") - 1) * 5, 6)
    best = both.filter(ratio.between(0.45, 2.4)).groupBy(*QUARTER).agg(F.min_by(F.struct("member", "value", "template"), F.struct(score, "template")).alias("_best"))
    return best.select(*QUARTER, "_best.*")


def residual_vote(df: DataFrame, conflicts: dict[str, list[str]] | None = None) -> DataFrame:
    """whose a quarter's residual is, by a vote of the company's other quarters.

    The residual is over max(0.08, 6 %) of a revenue over 0.2. Each member (over 0.02) of another quarter that this one lacks votes
    with 1 / distance * (0.55 + its share there, held within 0.04 and 1.2). The winner needs 0.55 (0.28 if alone and within 24
    quarters) and 1.18 times the second's score; of equal scores the nearer, then the smaller name. `conflicts` names members that
    a present member rules out.
    """
    rows = df.filter(F.col("value") > 0.02)
    sets = rows.groupBy(*QUARTER, "revenue").agg(F.sum("value").alias("_sum"), F.collect_set("member").alias("_have"))
    residual = F.col("revenue") - F.col("_sum")
    open_ = sets.filter((F.col("revenue") > 0.2) & (residual > F.greatest(F.lit(0.08), F.col("revenue") * 0.06))).select(*QUARTER, "_have", F.round(residual, 3).alias("value"))
    share = F.when(F.col("revenue") > 0.02, F.greatest(F.lit(0.04), F.least(F.lit(1.2), F.col("value") / F.col("revenue")))).otherwise(0.18)
    votes = rows.filter(F.col("member") != REST).select("company", F.col("q_ord").alias("_q"), "member", (0.55 + share).alias("_weight"))
    both = open_.join(votes, "company").filter((F.col("_q") != F.col("q_ord")) & ~F.array_contains("_have", F.col("member")))
    for present, ruled_out in (conflicts or {}).items():
        both = both.filter(~(F.array_contains("_have", F.lit(present)) & F.col("member").isin(*ruled_out)))
    distance = F.abs(F.col("_q") - F.col("q_ord"))
    scored = both.groupBy(*QUARTER, "value", "member").agg(F.round(F.sum(F.col("_weight") / distance), 6).alias("score"), F.min(distance).alias("_near"))
    order = _whole().orderBy(F.desc("score"), "_near", "member")
    ranked = scored.withColumn("_rank", F.row_number().over(order)).withColumn("_second", F.lead("score").over(order)).filter(F.col("_rank") == 1)
    enough = F.col("score") >= F.when(F.col("_second").isNull() & (F.col("_near") <= 24), 0.28).otherwise(0.55)
    return ranked.filter(enough & (F.col("_second").isNull() | (F.col("score") >= F.col("_second") * 1.18))).select(*QUARTER, "member", "value", "score")


def nearby(statements: DataFrame, members: DataFrame, reach: int = 2) -> DataFrame:
    """members for quarters without any, from the best quarter at most `reach` away, scaled to the revenue.

    Templates cover 0.62 to 1.18 of their revenue; the least 100 * distance - 4 * members + 20 * |coverage - 1| counts, the earliest
    of equals. Each template is offered to the quarters it can serve, so the join is on equal quarters.
    """
    sets = _snapshots(members.join(statements, QUARTER))
    empty = statements.join(sets.select(*QUARTER), QUARTER, "left_anti").filter(F.col("revenue") > 0.02)
    around = F.array(*(F.lit(d).cast("long") for d in range(-reach, reach + 1) if d))
    offered = sets.filter(F.col("coverage").between(0.62, 1.18)).select("company", F.col("q_ord").alias("template"), "members", "sum", "coverage", F.explode(around).alias("_d")).withColumn("q_ord", F.col("template") + F.col("_d"))
    score = F.round(100 * F.abs("_d") - 4 * F.size("members") + 20 * F.abs(F.col("coverage") - 1), 6)
    best = empty.join(offered, QUARTER).groupBy(*QUARTER, "revenue").agg(F.min_by(F.struct("template", "members", "sum"), F.struct(score, "template")).alias("_best"))
    rows = best.select(*QUARTER, "revenue", "_best.template", "_best.sum", F.explode("_best.members").alias("member", "_v"))
    return rows.select(*QUARTER, "member", F.round(F.col("_v") / F.col("sum") * F.col("revenue"), 3).alias("value"), "template")


def fuse_breakdowns(df: DataFrame, rest: str = "other_opex") -> DataFrame:
    """One breakdown from several sources' collections (company, q_ord, source, priority, member, value, total).

    Suspicious collections go. A collection scores its priority, 2 for each of up to six members and 12 times its share of the total
    (at most 1); each member comes from the collection with the highest score plus a thousandth of its value. Where members then
    exceed the total by 2 %, the best collection is taken whole; else, with two members or more and over max(1.5 %, 0.05) left, a
    residual is added. A breakdown that looks suspicious after all gives no rows. Ties go to the smaller source name.
    """
    part = [*QUARTER, "source"]
    odd = suspicious(df, part).select(*part, "suspicious")
    sound = df.join(odd, part).filter(~F.col("suspicious"))
    here = Window.partitionBy(*part)
    share = F.when(F.col("total") > 0, F.least(F.sum("value").over(here) / F.col("total"), F.lit(1.0))).otherwise(0.0)
    scored = sound.withColumn("_score", F.round(F.col("priority") + 2 * F.least(F.count(F.lit(1)).over(here), F.lit(6)) + 12 * share, 6))
    by_member = scored.groupBy(*QUARTER, "total", "member").agg(F.min_by(F.struct("source", "value"), F.struct(-F.round(F.col("_score") + F.least(F.col("value"), F.lit(999.0)) / 1000, 6), "source")).alias("_best")).select(*QUARTER, "total", "member", "_best.*")
    flagged = suspicious(by_member, QUARTER).select(*QUARTER, F.col("suspicious").alias("_odd"))
    sums = by_member.groupBy(*QUARTER, "total").agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_n")).join(flagged, QUARTER).filter(~F.col("_odd"))
    over = sums.filter((F.col("total") > 0) & (F.col("_sum") > F.col("total") * 1.02)).select(*QUARTER)
    best = scored.groupBy(*QUARTER).agg(F.min_by("source", F.struct(-F.col("_score"), "source")).alias("source"))
    whole = scored.join(over, QUARTER, "left_semi").join(best, part).select(*QUARTER, "member", "value", "source")
    mixed = by_member.join(sums.select(*QUARTER), QUARTER, "left_semi").join(over, QUARTER, "left_anti").select(*QUARTER, "member", "value", "source")
    left = F.round(F.col("total") - F.col("_sum"), 3)
    residual = sums.filter((F.col("total") > 0) & (F.col("_n") >= 2) & (left > F.greatest(F.col("total") * 0.015, F.lit(0.05)))).select(*QUARTER, F.lit(rest).alias("member"), left.alias("value"), F.lit("derived_residual").alias("source"))
    return whole.unionByName(mixed).unionByName(residual)


def neighbour_mean(rows: DataFrame, member: str, least_share: float = 0.35) -> DataFrame:
    """F8: a member's value above `least_share` of the revenue gives way to the mean (3 digits) of its values above zero in the quarters
    before and after, in the same year; `replaced` tells where."""
    own = rows.filter((F.col("member") == member) & (F.col("value") > 0)).groupBy("company", "q_ord").agg(F.max("value").alias("_v"))
    near = own.withColumn("_to", F.explode(F.array(F.col("q_ord") - 1, F.col("q_ord") + 1))).filter(F.floor(F.col("_to") / 4) == F.floor(F.col("q_ord") / 4))
    means = near.groupBy("company", F.col("_to").alias("q_ord")).agg(F.round(F.avg("_v"), 3).alias("_mean"))
    far = F.coalesce((F.col("member") == member) & (F.col("revenue") > 0) & (F.try_divide("value", "revenue") > least_share) & (F.col("_mean") > 0), F.lit(False))
    return rows.join(means, ["company", "q_ord"], "left").withColumn("replaced", far).withColumn("value", F.when(F.col("replaced"), F.col("_mean")).otherwise(F.col("value"))).drop("_mean")


def drop_sparse(rows: DataFrame, optional: list[str]) -> DataFrame:
    """quarters (company, q_ord, member, value, revenue) whose named rows cover less than 0.72 of the revenue while a residual
    (otherrevenue) of over 0.28 fills it become one row, reportedrevenue; of others the optional members below 0.015 of it go."""
    per = Window.partitionBy("company", "q_ord")
    whole = F.greatest(F.col("revenue"), F.lit(0.001))
    named = F.sum(F.when(F.col("member") != "otherrevenue", F.col("value"))).over(per)
    residual = F.max(F.when(F.col("member") == "otherrevenue", F.col("value"))).over(per)
    sparse = F.coalesce((F.coalesce(named, F.lit(0.0)) / whole < 0.72) & (residual / whole > 0.28), F.lit(False))
    marked = rows.withColumn("_sparse", sparse).withColumn("_tiny", F.col("member").isin(*optional) & (F.col("value") / whole < 0.015))
    single = marked.filter(F.col("_sparse") & (F.col("revenue") > 0.02)).select("company", "q_ord", F.lit("reportedrevenue").alias("member"), F.round("revenue", 3).alias("value"), "revenue").distinct()
    return marked.filter(~F.col("_sparse") & ~F.col("_tiny")).select("company", "q_ord", "member", "value", "revenue").unionByName(single)


def absorb_residual(rows: DataFrame) -> DataFrame:
    """a residual (otherrevenue) of 0.01 to 0.1 of the revenue goes to the quarter's members by the mean of their shares in the
    rows before and after (3 digits), if all three have the same members; other rows stay as they are."""
    per, order = Window.partitionBy("company", "q_ord"), Window.partitionBy("company").orderBy("q_ord")
    real = rows.filter("member <> 'otherrevenue'")
    share = F.try_divide(F.col("value"), F.sum("value").over(per))
    quarters = rows.withColumn("_share", share).groupBy("company", "q_ord").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("member") != "otherrevenue", F.col("member")))), "|").alias("_own"), F.map_from_entries(F.collect_list(F.struct("member", "_share"))).alias("_shares"), F.max(F.when(F.col("member") == "otherrevenue", F.col("value"))).alias("_rest"), F.max("revenue").alias("_revenue"))
    near = quarters.select("company", "q_ord", "_own", "_rest", "_revenue", *(f(c).over(order).alias(f"_{n}{c}") for n, f in (("a", F.lag), ("b", F.lead)) for c in ("_own", "_shares")))
    part = F.col("_rest") / F.greatest("_revenue", F.lit(0.001))
    good = near.filter((F.col("_own") != "") & (F.col("_a_own") == F.col("_own")) & (F.col("_b_own") == F.col("_own")) & (part > 0.01) & (part <= 0.1)).select("company", "q_ord", "_rest", "_a_shares", "_b_shares")
    weighed = real.join(good, ["company", "q_ord"], "left").withColumn("_w", (F.col("_a_shares")[F.col("member")] + F.col("_b_shares")[F.col("member")]) / 2)
    more = F.round(F.col("value") + F.try_divide(F.col("_rest") * F.col("_w"), F.sum("_w").over(per)), 3)
    out = weighed.select("company", "q_ord", "member", F.coalesce(more, F.col("value")).alias("value"), "revenue")
    return out.unionByName(rows.filter("member = 'otherrevenue'").join(good, ["company", "q_ord"], "left_anti").select(out.columns))

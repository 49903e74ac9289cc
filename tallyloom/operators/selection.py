"""Choosing among facts, axes, rows and sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import tolerance
from tallyloom.operators import labels
from tallyloom.operators.breakdown import PLACEHOLDERS
from tallyloom.operators.periods import concept_rank, segment_rank



def best_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the facts of one concept and span, the best by rank: filed within 210 days, sooner, namespace, concept, later filed,
    accession; of equal ones the largest value. Keys name the concept, `start` and `end`."""
    return _ranked_by(facts, keys, concept_rank)


def best_segment_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of a member's facts of one concept and span, the best by concept priority, form that suits the span, class of filing lag,
    nearness to that class's usual lag, nearness to 91 days, filing date; of equal ones the largest value."""
    return _ranked_by(facts, keys, segment_rank)


def _ranked_by(facts: DataFrame, keys: list[str], rank: Callable[[Column], list[Column]]) -> DataFrame:
    row, rest = F.struct(*facts.columns), [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(F.max_by(row, F.struct(*rank(row), "value")).alias("_best"))
    return best.select(*keys, *(F.col("_best")[c].alias(c) for c in rest))


#: Parts of axis names that speak for segments and for products.
BUSINESS_AXES = ("statementbusinesssegmentsaxis", "operatingsegmentsaxis", "businesssegmentsaxis", "lineofbusinessaxis", "reportablesegmentsaxis", "segmentaxis")
PRODUCT_AXES = ("productorserviceaxis", "classesofbusinessesaxis", "classesofbusinessaxis", "majorproductlinesaxis", "applicationaxis", "enduseaxis", "technologyaxis", "platformaxis")


def axis_kind(axis: Column) -> Column:
    """Whether an axis divides by product, by business or otherwise."""
    low = F.lower(axis)
    return F.when(low.rlike("|".join(PRODUCT_AXES)), "product").when(low.rlike("|".join([*BUSINESS_AXES, "segment", "business"])), "business").otherwise("other")


def best_axis(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the axes that facts (axis, axis_priority, member, end, concept_priority) are told by, the best one, with its score.

    An axis scores its priority; 28 more for three specific members or more on a product axis without geographic ones, 12 for two on
    a business axis; 90, 70 or 36 less where 95, 66 or 40 hundredths of the members are geographic; 18 less with fewer than two specific
    members, and for each aggregate label; 10 less with over twelve members. Ties go to more periods, two to eight specific members,
    more specific members, the larger sum of concept priorities, and then the name that comes first.
    """
    axes = facts.groupBy(*keys, "axis").agg(F.max("axis_priority").alias("priority"), F.collect_set("member").alias("_members"), F.countDistinct("end").alias("n_periods"), F.sum("concept_priority").alias("_weight"))
    low = F.transform("_members", F.lower)
    specific = F.size(F.filter("_members", lambda m: ~labels.dropped(F.lower(m), low)))
    geographic = F.size(F.filter("_members", labels.geographic))
    sums = F.size(F.filter("_members", labels.aggregate_like))
    axes = axes.select("*", axis_kind(F.col("axis")).alias("_kind"), F.size("_members").alias("n_members"), specific.alias("n_specific"), geographic.alias("_geo"), sums.alias("_sums"))
    share, alone = F.col("_geo") / F.col("n_members"), F.col("_geo") == 0
    gain = F.when((F.col("_kind") == "product") & (F.col("n_specific") >= 3) & alone, 28).when((F.col("_kind") == "business") & (F.col("n_specific") >= 2) & alone, 12).otherwise(0)
    loss = F.when(share >= 0.95, 90).when(share >= 0.66, 70).when(share >= 0.4, 36).otherwise(0) + F.when(F.col("n_specific") < 2, 18).otherwise(0) + 18 * F.col("_sums") + F.when(F.col("n_members") > 12, 10).otherwise(0)
    scored = axes.withColumn("score", (F.col("priority") + gain - loss).cast("long"))
    order = F.struct(-F.col("score"), -F.col("n_periods"), ~F.col("n_specific").between(2, 8), -F.col("n_specific"), -F.col("_weight"), "axis")
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("axis", "score", "n_periods", F.col("n_specific").cast("long").alias("n_specific")), order).alias("_best"))
    return best.select(*keys, "_best.*")


def last_writer(offers: DataFrame, keys: list[str]) -> DataFrame:
    """Whose rows a quarter ends up with when sources (source, source_order, kind, n_rows) write in turn.

    A `structure` replaces whatever is there; `segments` replace what has no more rows than they do. So the last structure counts, and
    of the segments after it those with most rows, the later of equal ones, if they have as many as it. Offers without rows are none.
    """
    real = offers.filter(F.col("n_rows") > 0)
    begin = F.coalesce(F.max(F.when(F.col("kind") == "structure", F.col("source_order"))).over(Window.partitionBy(*keys)), F.lit(-1))
    left = real.withColumn("_from", begin).filter(F.col("source_order") >= F.col("_from"))
    best = left.groupBy(*keys).agg(F.max_by(F.struct("source", "kind", "n_rows"), F.struct("n_rows", "source_order")).alias("_best"))
    return best.select(*keys, "_best.*")


def _folded(rows: DataFrame, keys: list[str], order: str, prefer: Callable[[Column, Column], Column], fill: str | None) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, order)]
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_rows"))
    first = F.transform("_rows", lambda r: F.struct(*(r[c].alias(c) for c in rest)))

    def step(now: Column, row: Column) -> Column:
        better = prefer(now, row)
        most = F.greatest(F.coalesce(now["value"], F.lit(0.0)), F.coalesce(row["value"], F.lit(0.0)))
        pick = {c: F.when(better, row[c]).otherwise(now[c]) for c in rest} | {"value": most}
        if fill:
            blank = lambda c: F.when(c != "", c)
            pick[fill] = F.coalesce(blank(pick[fill]), blank(row[fill]), blank(now[fill]), pick[fill])
        return F.struct(*(pick[c].alias(c) for c in rest))

    one = gathered.withColumn("_all", first).select(*keys, F.aggregate(F.slice("_all", 2, F.size("_all")), F.element_at("_all", 1), step).alias("_r"))
    return one.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def merge_newest(rows: DataFrame, keys: list[str], order: str, fill: str) -> DataFrame:
    """One row for each key of rows (filed, value, ...) taken in turn: a newer filing's attributes, or those of a row of the same
    filing date whose value is above the largest so far; the largest value of all; `fill` from any row where the chosen has none.

    A key's rows are folded in one place: they are one member's in one quarter. Null dates and values count as "" and 0.
    """
    filed, value = lambda r: F.coalesce(r["filed"].cast("string"), F.lit("")), lambda r: F.coalesce(r["value"], F.lit(0.0))
    return _folded(rows, keys, order, lambda a, b: (filed(b) > filed(a)) | ((filed(b) == filed(a)) & (value(b) > value(a))), fill)


def merge_canonical(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As merge_newest, where of rows of one date a value larger by over 0.002 counts, and else the longer name."""

    def prefer(a: Column, b: Column) -> Column:
        day = lambda r: F.coalesce(F.unix_date(r["filed"]), F.lit(-(1 << 30)))
        more = F.coalesce(b["value"], F.lit(0.0)) - F.coalesce(a["value"], F.lit(0.0))
        longer = F.length(F.trim(F.coalesce(b["name"], F.lit("")))) > F.length(F.trim(F.coalesce(a["name"], F.lit(""))))
        return (day(b) > day(a)) | ((day(b) == day(a)) & F.when(F.abs(more) > 0.002, more > 0).otherwise(longer))

    return _folded(rows, keys, order, prefer, None)


def score_candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How well each source's rows (source, member, value, lag_days, revenue) explain a quarter.

    22 for two rows or more, else -14; 5 more from three on, 4 less for each past seven and 5 for each past ten; by the sum against the
    revenue 18 within 8 hundredths, 10 within 25, -18 below 0.36 or above 1.4, else 2; 8 less if of three or more one is above 0.84 of
    the sum; 4 less for each aggregate label, if there are two among four or more; by the median lag -16 above 900 days, -10 above 540,
    -6 below -2, 3 up to 260.
    """
    sums = labels.aggregate_like(F.col("member"))
    groups = rows.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("_sum"), F.max("value").alias("_top"), F.count_if(sums).alias("_n_sums"), F.median("lag_days").alias("_lag"), F.max("revenue").alias("_revenue"), F.min("source_order").alias("source_order"))
    n, lag = F.col("n_rows"), F.col("_lag")
    ratio = F.when(F.col("_revenue") > 0.02, F.col("_sum") / F.col("_revenue"))
    off = F.abs(ratio - 1)
    top = F.when(F.col("_sum") > 0.02, F.col("_top") / F.col("_sum")).otherwise(1.0)
    score = F.when(n >= 2, 22).otherwise(-14) + F.when(n >= 3, 5).otherwise(0) - 4 * F.greatest(n - 7, F.lit(0)) - 5 * F.greatest(n - 10, F.lit(0))
    score += F.when(ratio.isNull(), 0).when(off <= 0.08, 18).when(off <= 0.25, 10).when((ratio < 0.36) | (ratio > 1.4), -18).otherwise(2)
    score -= F.when((top > 0.84) & (n >= 3), 8).otherwise(0) + F.when((F.col("_n_sums") >= 2) & (n >= 4), 4 * F.col("_n_sums")).otherwise(0)
    score += F.when(lag > 900, -16).when(lag > 540, -10).when(lag < -2, -6).when(lag <= 260, 3).otherwise(0)
    return groups.select(*keys, "source", "source_order", "n_rows", off.alias("_off"), score.cast("long").alias("score"))


def best_candidate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The source that scores most; ties go to the sum nearer to the revenue, to more rows, and to the earlier source."""
    order = F.struct(-F.col("score"), F.round(F.coalesce("_off", F.lit(9e9)), 9), -F.col("n_rows"), "source_order")
    best = score_candidates(rows, keys).groupBy(*keys).agg(F.min_by(F.struct("source", "n_rows", "score"), order).alias("_best"))
    return best.select(*keys, "_best.*")


def best_expenses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidate lists (candidate, candidate_order, member, value) for expenses of `total`, the best real one.

    A list scores 100 a row, its sum up to the total, and 10 less a unit that it is off by more than 0.2; lists that B6 finds suspicious
    are none. Of equal ones the earlier counts; keys without a list give no row.
    """
    each = [*keys, "candidate"]
    odd = suspicious_expenses(rows.withColumn("statement", F.array().cast("array<double>")), each)
    size = F.sum(F.greatest(F.col("value"), F.lit(0.0)))
    lists = rows.groupBy(*each).agg(F.count(F.lit(1)).alias("n_rows"), size.alias("covered"), F.max("total").alias("_total"), F.min("candidate_order").alias("_order")).join(odd.filter(~F.col("suspicious")), each)
    total = F.greatest(F.coalesce("_total", F.lit(0.0)), F.lit(0.0))
    score = F.col("n_rows") * 100 + F.least("covered", total) - F.greatest(F.abs(F.col("covered") - total) - 0.2, F.lit(0.0)) * 10
    best = lists.withColumn("score", F.round(score, 3)).groupBy(*keys).agg(F.min_by(F.struct("candidate", "n_rows", "score"), F.struct(-F.col("score"), "_order")).alias("_best"))
    return best.select(*keys, "_best.*")


def suspicious_expenses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether expenses (member, value, total, and `statement`, an array of the quarter's figures) are no real list.

    Values above 0.02 count, to three digits, two at least. The list is none if one value stands four times or more under four or more
    placeholder names; or if all of four or more are one value, and their sum is far above the total (1.35 times, and 0.35 or 3
    hundredths), or the value itself is (1.08 times, and 0.12 or a hundredth), or a figure of the statement is that value within 0.05
    or a quarter hundredth.
    """
    size = F.round(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)), 3)
    plain = F.regexp_replace(F.lower("member"), "[^a-z0-9]+", "")
    holder = F.when(plain.isin(*sorted({p.replace("_", "") for p in PLACEHOLDERS})), plain)
    by_value = rows.groupBy(*keys, size.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(holder).alias("_holders"), F.max("total").alias("_total"), F.max("statement").alias("_statement"))
    some = F.col("_v") > 0.02
    groups = by_value.groupBy(*keys).agg(F.sum(F.when(some, F.col("_n"))).alias("_n"), F.count_if(some).alias("_different"), F.sum(F.when(some, F.col("_v") * F.col("_n"))).alias("_sum"), F.max(F.when(some, F.col("_v"))).alias("_most"), F.max(F.when(some, F.struct("_n", "_v", "_holders"))).alias("_modal"), F.max("_total").alias("_total"), F.max("_statement").alias("_statement"))
    total = F.greatest(F.coalesce("_total", F.lit(0.0)), F.lit(0.0))
    far = (total > 0.05) & ((F.col("_sum") > total * 1.35 + F.greatest(total * 0.03, F.lit(0.35))) | (F.col("_most") > total * 1.08 + F.greatest(total * 0.01, F.lit(0.12))))
    figures = F.filter(F.transform("_statement", lambda v: F.round(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), 3)), lambda v: v > 0.02)
    echo = F.exists(figures, lambda v: F.abs(v - F.col("_most")) <= F.greatest(F.lit(0.05), v * 0.0025))
    equal = (F.col("_n") >= 4) & (F.col("_different") == 1) & (far | echo)
    placeholder = (F.col("_modal._n") >= 4) & (F.col("_modal._holders") >= 4)
    return groups.select(*keys, F.coalesce((F.col("_n") >= 2) & (placeholder | equal), F.lit(False)).alias("suspicious"))


def mark_ineligible(rows: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (notes: array of strings) whose key has a note in `notes` (note) are not eligible and carry it once; others stay."""
    noted = rows.join(notes.select(*keys, "note"), keys, "left")
    more = F.when(F.col("note").isNotNull(), F.array_union("notes", F.array("note"))).otherwise(F.col("notes"))
    return noted.withColumn("eligible", F.col("note").isNull() & F.col("eligible")).withColumn("notes", more).drop("note")


def skipped_overflows(rows: DataFrame, keys: list[str], standard: str) -> DataFrame:
    """Whether expenses (member, value, opex) above the total are let pass: all members match `standard`, two at least, and the
    sum is beyond the tolerance, but up to 1.12 times the total, or 1.4 times with exactly three."""
    named = F.trim("member") != ""
    sums = rows.groupBy(*keys).agg(F.round(F.sum(F.abs("value")), 3).alias("_sum"), F.max("opex").alias("_opex"), F.count(F.lit(1)).alias("_n"), F.count_if(named).alias("_named"), F.count_if(named & ~F.lower("member").rlike(standard)).alias("_other"))
    ratio = F.try_divide("_sum", "_opex")
    good = (F.col("_opex") > 0) & (F.col("_named") >= 2) & (F.col("_other") == 0) & (F.col("_sum") - F.col("_opex") > tolerance(F.col("_opex"))) & ((ratio <= 1.12) | ((F.col("_named") == 3) & (ratio <= 1.4)))
    return sums.select(*keys, F.coalesce(good, F.lit(False)).alias("skipped"))


def reporting_cycle(q_ord: Column) -> Column:
    """Half-year for second quarters, annual for fourth ones, else quarterly."""
    return F.when(q_ord % 4 == 1, "half-year").when(q_ord % 4 == 3, "annual").otherwise("quarterly")


def by_policy(quarters: DataFrame, policies: DataFrame) -> DataFrame:
    """A company's quarters (company, q_ord, has_revenue, has_expense) that its policy shows; all of them if it would show none.

    Policies (company, classified_only, cycles: array, need_revenue, need_expense): nulls mean no, any cycle, yes and no.
    """
    given = quarters.join(policies, "company", "left")
    wanted = F.coalesce(F.size(F.col("cycles")) <= 0, F.lit(True)) | F.array_contains("cycles", reporting_cycle(F.col("q_ord")))
    good = ~F.coalesce("classified_only", F.lit(False)) | (F.coalesce(wanted, F.lit(True)) & (~F.coalesce("need_revenue", F.lit(True)) | F.col("has_revenue")) & (~F.coalesce("need_expense", F.lit(False)) | F.col("has_expense")))
    marked = given.withColumn("_good", good)
    marked = marked.withColumn("_any", F.max("_good").over(Window.partitionBy("company")))
    return marked.filter(F.col("_good") | ~F.col("_any")).select(*quarters.columns)


def one_epoch(rows: DataFrame, epochs: DataFrame) -> DataFrame:
    """Rows of quarters that mix members of several epochs (company, member, epoch, first_q), less those of other epochs than the
    one in force: the latest that begins by the quarter, else the first. Quarters of one epoch, and such as would lose all, stay."""
    own = epochs.select("company", "member", "epoch").distinct()
    begins = epochs.groupBy("company", "epoch").agg(F.min("first_q").alias("_first"))
    per = Window.partitionBy("company", "q_ord")
    held = rows.join(own.groupBy("company", "member").agg(F.collect_set("epoch").alias("_epochs")), ["company", "member"], "left")
    spans = begins.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("_first", "epoch"))).alias("_begins"))
    held = held.join(spans, "company", "left")
    begun = F.filter("_begins", lambda b: b["_first"] <= F.col("q_ord"))
    held = held.withColumn("_now", F.coalesce(F.try_element_at(begun, F.lit(-1))["epoch"], F.try_element_at("_begins", F.lit(1))["epoch"]))
    held = held.withColumn("_single", F.when(F.size("_epochs") == 1, F.element_at("_epochs", 1))).withColumn("_good", F.coalesce(F.array_contains("_epochs", F.col("_now")), F.lit(False)))
    mixed = F.size(F.collect_set("_single").over(per)) > 1
    held = held.withColumn("_mixed", mixed).withColumn("_any", F.max("_good").over(per))
    return held.filter(~F.col("_mixed") | F.col("_good") | ~F.col("_any")).select(*rows.columns)


def shares_to_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """F16: rows (mode, mix_pct, flow, value, revenue) that tell shares, in values (3 digits).

    Rows up to 0.001 go first, results up to 0.02 at the end. A row is a share by its mode, or where two or more rows, all up to 100.5,
    sum to 100 within 4.5, and there is revenue above 0.02. Its share is mix_pct if that is 0 to 100.5, else its value; other rows give
    their flow, or else their value.
    """
    per = Window.partitionBy(*keys)
    real = rows.filter(F.col("value") > 0.001)
    shape = (F.count(F.lit(1)).over(per) >= 2) & (F.max("value").over(per) <= 100.5) & (F.abs(F.sum("value").over(per) - 100) <= 4.5)
    real = real.withColumn("_share", (F.col("revenue") > 0.02) & (F.coalesce(F.col("mode").isin("share", "mix", "percentage"), F.lit(False)) | shape))
    share = F.when(F.col("mix_pct").between(0, 100.5), F.col("mix_pct")).otherwise(F.col("value"))
    told = F.when(F.coalesce("_share", F.lit(False)), F.col("revenue") * share / 100).otherwise(F.coalesce("flow", "value"))
    return real.withColumn("value", F.round(told, 3)).filter(F.col("value") > 0.02).drop("_share")


def scale_flows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """flows (member, flow, revenue) that exceed the revenue by more than 0.02 and 2 thousandths, scaled to it in order of members;
    the last takes what rounding leaves. Others stay, and `scaled` tells which."""
    per, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("member")
    flow = F.coalesce("flow", F.lit(0.0))
    total = rows.withColumn("_total", F.sum(flow).over(per)).withColumn("_last", F.row_number().over(order) == F.count(F.lit(1)).over(per))
    over = (F.col("revenue") > 0) & (F.col("_total") > F.col("revenue") + F.greatest(F.lit(0.02), F.col("revenue") * 0.002))
    part = total.withColumn("scaled", F.coalesce(over, F.lit(False))).withColumn("_part", F.round(F.greatest(F.try_divide(flow * F.col("revenue"), F.col("_total")), F.lit(0.0)), 3))
    before = F.sum("_part").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.round(F.greatest(F.col("revenue") - F.coalesce(before, F.lit(0.0)), F.lit(0.0)), 3)
    return part.withColumn("flow", F.when(~F.col("scaled"), flow).when(F.col("_last"), rest).otherwise(F.col("_part"))).drop("_total", "_last", "_part")


def accepted(rows: DataFrame, keys: list[str], least: float = 0.82, most: float = 1.08) -> DataFrame:
    """whether a breakdown (value, expected) sums, by magnitude, to between `least` and `most` times what is expected; without an
    expectation above zero it is accepted."""
    sums = rows.groupBy(*keys).agg(F.sum(F.abs(F.coalesce("value", F.lit(0.0)))).alias("_sum"), F.max("expected").alias("_expected"))
    ratio = F.round(F.try_divide("_sum", "_expected"), 9)
    good = F.when(F.col("_expected") > 0, (F.col("_sum") > 0) & ratio.between(least, most)).otherwise(True)
    return sums.select(*keys, good.alias("accepted"))


def ordered(rows: DataFrame, keys: list[str], own_order: DataFrame | None = None) -> DataFrame:
    """The place (from 1) of each row in its group: by a given order of members (member, place), then by value, the largest first,
    then by name; members without a given place come last."""
    listed = rows.join(own_order.select("member", F.col("place").alias("_place")), "member", "left") if own_order is not None else rows.withColumn("_place", F.lit(None).cast("long"))
    order = Window.partitionBy(*keys).orderBy(F.col("_place").asc_nulls_last(), F.col("value").desc_nulls_last(), "member")
    return listed.withColumn("place", F.row_number().over(order).cast("long")).select(*rows.columns, "place")

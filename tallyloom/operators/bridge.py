"""Bridges from revenue to net, repairs of whole quarters, rules and layouts beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.merging import preserve_missing
from tallyloom.operators.periods import field_rank


def _zero() -> Column:
    return F.lit(0.0)


def _most(least: float, *parts: Column) -> Column:
    return F.greatest(F.lit(least), *parts)


def _near(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """|a - b| within `absolute`, or within `relative` of |b| where that is above 0.05."""
    off = F.abs(a - b)
    return (off <= absolute) | F.when(F.abs(b) > 0.05, off <= relative * F.abs(b)).otherwise(off <= relative)


def operating_stage(df: DataFrame) -> DataFrame:
    """operating expenses and income that fit the gross profit (revenue, cost, gross, opex, op_income, sgna, rnd, opex_sum).

    Expenses that exceed the gross profit, but not the revenue, and leave no more than the gross profit when the costs are taken off are
    total costs, if no operating income is given, no breakdown sums to them, and they aren't gross less income: then both follow from
    them. Else the expenses stay if they are within 0.25 or 8 hundredths of gross less income (12, if the breakdown agrees) and not
    above it by more than 0.02 and 2 thousandths, nor above the gross profit by 0.25; else gross less income counts. Without an income,
    expenses above the revenue or the gross profit by more than 0.25 are 0. `total_costs` and `reliable` tell which.
    """
    c = F.col
    opex, base = F.greatest("opex", _zero()), c("op_income")
    opex = F.when(c("opex").isNotNull(), opex)
    gross, cost, revenue = c("gross"), F.greatest("cost", _zero()), F.when(c("revenue").isNotNull(), F.greatest("revenue", _zero()))
    listed = F.coalesce("opex_sum", _zero())
    listed_agrees = (listed > 0.05) & (F.abs(listed - opex) <= _most(0.35, listed * 0.05))
    less_cost = F.greatest(opex - cost, _zero())
    proxy = c("cost").isNotNull() & (opex > gross + 0.25) & (opex <= revenue + _most(0.35, revenue * 0.02)) & (less_cost <= gross + _most(0.35, gross * 0.04))
    total = F.coalesce(proxy & base.isNull() & ~F.coalesce(listed_agrees, F.lit(False)), F.lit(False))
    bridge = F.when(gross.isNotNull() & base.isNotNull(), F.greatest(gross - base, _zero()))
    off = F.abs(opex - bridge)
    relative = F.when(bridge > 0.05, F.try_divide(off, bridge)).otherwise(off)
    fits = ~(opex > gross + 0.25) & ~(opex > bridge + _most(0.02, bridge * 0.002)) & ((off <= 0.25) | (relative <= 0.08) | (listed_agrees & (relative <= 0.12)))
    too_much = F.coalesce(opex > revenue + 0.25, F.lit(False)) | F.coalesce(opex > gross + 0.25, F.lit(False))
    reliable = F.when(opex.isNull(), False).when(bridge.isNull(), ~too_much).otherwise(F.coalesce(fits, F.lit(False)))
    value = F.when(opex.isNull(), bridge).when(bridge.isNull(), F.when(too_much, 0.0).otherwise(opex)).otherwise(F.when(fits, opex).otherwise(bridge))
    return df.withColumns({
        "total_costs": total,
        "reliable": reliable & ~total,
        "op_resolved": F.round(F.when(total, revenue - opex).otherwise(base), 3) + _zero(),
        "opex_resolved": F.round(F.when(total, less_cost).otherwise(value), 3) + _zero(),
    })


def pretax_stage(df: DataFrame) -> DataFrame:
    """pretax and non-operating income (pretax, net, tax, non_op, op_resolved). Pretax stays if it is within 0.25 or 5 hundredths of net
    plus tax or of operating plus non-operating income, or neither is known; else the first known one counts. Non-operating income
    stays within 0.25 or 8 hundredths of pretax less operating income, or if that isn't known; else that counts, as a residual."""
    c = F.col
    by_tax, by_stage = c("net") + c("tax"), c("op_resolved") + c("non_op")
    agrees = lambda other: F.coalesce(F.abs(c("pretax") - other) <= _most(0.25, F.abs(other) * 0.05), F.lit(False))
    pretax = F.when(c("pretax").isNotNull() & (agrees(by_tax) | agrees(by_stage)), c("pretax")).otherwise(F.coalesce(by_tax, by_stage, c("pretax")))
    staged = df.withColumn("pretax_resolved", F.round(pretax, 3) + _zero())
    rest = c("pretax_resolved") - c("op_resolved")
    keep = c("non_op").isNotNull() & (rest.isNull() | _near(c("non_op"), rest, 0.25, 0.08))
    return staged.withColumn("residual", F.coalesce(~keep & rest.isNotNull(), F.lit(False))).withColumn("non_op_resolved", F.round(F.when(keep, c("non_op")).otherwise(rest), 3) + _zero())


#: The fields of the operating stage and below, and those of the whole bridge.
LOWER_FIELDS = ("sgna", "rnd", "other_opex", "opex", "op_income", "non_op", "pretax", "tax", "net")
BRIDGE_FIELDS = ("revenue", "cost", "gross", *LOWER_FIELDS)


def merge_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Quarters of either side (company, q_ord, BRIDGE_FIELDS, segment_sum, source), each field the primary's if it has any.

    The fallback's whole bridge counts, where it has a value, if the primary lacks cost and gross, the fallback has both and revenue, and the
    primary looks broken: expenses above the revenue by 0.25, or segments by that and 8 hundredths. Its operating stage counts if the
    other stages agree, its own bridge is sound, and expenses, income or non-operating income differ by more than 1.2 and about a
    quarter (0.24, 0.24 and 0.4 of the fallback's; the latter two with 0.4 more). `source` gets a mark for each.
    """
    fields, keys = list(BRIDGE_FIELDS), ["company", "q_ord"]
    other = fallback.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.col("source").alias("_source"), F.lit(True).alias("_there"))
    both = primary.withColumn("_own", F.lit(True)).join(other, keys, "full_outer")
    p, f = F.col, lambda name: F.col(f"_{name}")
    paired = p("_own").isNotNull() & p("_there").isNotNull()
    true = lambda c: F.coalesce(c, F.lit(False))
    broken = true(p("opex") > p("revenue") + 0.25) | true(F.coalesce("segment_sum", _zero()) > p("revenue") + _most(0.25, p("revenue") * 0.08))
    whole = paired & p("cost").isNull() & p("gross").isNull() & f("revenue").isNotNull() & f("cost").isNotNull() & f("gross").isNotNull() & broken
    alike = lambda name, least, share: F.coalesce(F.abs(p(name) - f(name)) <= _most(least, F.greatest(F.abs(p(name)), F.abs(f(name))) * share), F.lit(True))
    others = alike("revenue", 0.12, 0.006) & alike("gross", 0.12, 0.008) & alike("pretax", 0.18, 0.012) & alike("tax", 0.18, 0.02) & alike("net", 0.18, 0.012)
    sound = true(F.abs(f("opex") - F.greatest(f("gross") - f("op_income"), _zero())) <= _most(0.35, f("gross") * 0.03))
    far = lambda name, share, more: true(F.abs(p(name) - f(name)) > _most(1.2, F.abs(f(name)) * share + more))
    stage = paired & others & sound & (far("opex", 0.24, 0.0) | far("op_income", 0.24, 0.4) | far("non_op", 0.4, 0.4))
    marked = both.withColumn("_whole", whole).withColumn("_stage", stage)
    swapped = lambda name: p("_whole") | (p("_stage") if name in LOWER_FIELDS else F.lit(False))
    merged = {n: F.when(swapped(n), F.coalesce(f(n), p(n))).otherwise(F.coalesce(p(n), f(n))).alias(n) for n in fields}
    named = F.coalesce("source", F.lit("official"))
    # the later mark replaces the former, as it is made from the primary's name
    source = F.when(p("_stage"), F.concat(named, F.lit("+operating-stage-fallback"))).when(p("_whole"), F.concat(named, F.lit("+financial-fallback"))).otherwise(F.coalesce("source", "_source"))
    return marked.select(*keys, *merged.values(), source.alias("source"))


def assemble(facts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a quarter of the best fact (by rank of fields) of each field; sgna is its own, else the sum of sales_marketing and
    general_administrative, of which one may be missing. The end and filing date are those of the best fact of all."""
    row = F.struct("value", "end", "filed", "accession", "namespace_priority", "concept_priority")
    rank = F.struct(*field_rank(row), "value")
    each = [F.max_by("value", F.when(F.col("field") == f, rank)).alias(f) for f in (*fields, "sgna", "sales_marketing", "general_administrative")]
    best = F.max_by(F.struct("end", "filed"), rank).alias("_best")
    wide = facts.filter(F.col("value").isNotNull()).groupBy(*keys).agg(*each, best)
    parts = F.coalesce(F.col("sales_marketing") + F.col("general_administrative"), "sales_marketing", "general_administrative")
    return wide.select(*keys, *fields, F.coalesce("sgna", parts).alias("sgna"), "_best.end", "_best.filed")


def rule_facts(facts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """H9: facts (company, concept, start, end, value, members: map) under the names of the company's rules (member, filters: map of
    dimension to allowed members, exact: array of dimensions or null, aggregate). A fact fits if each filter's dimension holds an allowed
    member, and it has no dimensions but the exact ones where these are given. Aggregating rules sum by name, concept and span; the
    others give a row a fact. Rules are joined by company."""
    both = facts.join(rules.select("company", F.col("member").alias("rule"), "filters", "exact", "aggregate"), "company")
    fits = F.forall(F.map_entries("filters"), lambda e: F.coalesce(F.array_contains(e["value"], F.try_element_at(F.col("members"), e["key"])), F.lit(False)))
    only = F.col("exact").isNull() | (F.array_sort(F.map_keys("members")) == F.array_sort("exact"))
    found = both.filter(fits & only).withColumn("_one", F.when(~F.col("aggregate"), F.monotonically_increasing_id()))
    sums = found.groupBy(*keys, F.col("rule").alias("member"), "concept", "start", "end", "_one").agg(F.round(F.sum("value"), 3).alias("value"), F.count(F.lit(1)).alias("n_facts"))
    return sums.drop("_one")


def harmonise(rows: DataFrame) -> DataFrame:
    """quarters (company, q_ord, member, value, revenue) between two with the same members, two or more, that have fewer than two
    members, or others and either one above 0.82 of their sum or a sum outside 0.7 to 1.28 of the revenue: they get the neighbours'
    members, the revenue shared by the mean of their shares (3 digits; rows above 0.02). `synthetic` tells which. (A quarter that is
    made so holds its neighbours' members, which are then not other than its own: so rows as given decide.)"""
    order = Window.partitionBy("company").orderBy("q_ord")
    quarters = rows.groupBy("company", "q_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", "value")))).alias("now"), F.max("revenue").alias("revenue"))
    near = quarters.select("*", F.lag("now").over(order).alias("before"), F.lead("now").over(order).alias("after"))
    names = lambda m: F.array_sort(F.map_keys(m))
    total = lambda m: F.aggregate(F.map_values(m), _zero(), lambda a, v: a + v)
    few = F.size("now") < 2
    odd = (F.try_divide(F.array_max(F.map_values("now")), total("now")) >= 0.82) | ~F.coalesce(F.try_divide(total("now"), F.col("revenue")).between(0.7, 1.28), F.lit(True))
    bad = F.coalesce((F.size("before") >= 2) & (names("before") == names("after")) & (few | ((names("now") != names("before")) & odd)) & (F.col("revenue") > 0), F.lit(False))
    share = lambda m, k: F.try_divide(F.col(m)[k], total(m))
    made = F.transform(names("before"), lambda k: F.struct(k.alias("key"), F.round(F.col("revenue") * (share("before", k) + share("after", k)) / 2, 3).alias("value")))
    out = F.when(bad, F.filter(made, lambda r: r["value"] > 0.02)).otherwise(F.map_entries("now"))
    return near.withColumn("synthetic", bad).select("company", "q_ord", "revenue", "synthetic", F.explode(out).alias("r")).select("company", "q_ord", F.col("r.key").alias("member"), F.col("r.value").alias("value"), "synthetic")


def fill_recent(quarters: DataFrame, offered: DataFrame, field: str, most: int = 12) -> DataFrame:
    """the `most` newest of a company's quarters that lack `field` take it from `offered` (company, q_ord, field); a limit of the
    operator's own. `filled` tells which."""
    newest = Window.partitionBy("company", F.col(field).isNull()).orderBy(F.desc("q_ord"))
    lacking = quarters.withColumn("_n", F.row_number().over(newest))
    both = lacking.join(offered.select("company", "q_ord", F.col(field).alias("_offered")), ["company", "q_ord"], "left")
    take = F.col(field).isNull() & (F.col("_n") <= most) & F.col("_offered").isNotNull()
    return both.withColumn("filled", take).withColumn(field, F.when(F.col("filled"), F.col("_offered")).otherwise(F.col(field))).drop("_n", "_offered")


#: Patterns of segment names that stand for a way of disclosing (whole words, any case).
NAME_PATTERNS = {
    "entity": r"\b(company|corporation|group|business|businesses|railroad|energy)\b",
    "bank": r"\b(banking|markets|wealth|investment|consumer|commercial|community|asset)\b",
    "component": r"\b(revenue|revenues|service|services|transaction|processing|assessment)\b",
    "therapeutic": r"\b(endocrinology|oncology|neuroscience|immunology|aesthetics|hematologic|hematology|medical aesthetics|other product total|other endocrinology)\b",
    "product_line": r"\bmajor product line\b",
    "geographic": r"\b(north america|latin america|emea|europe|pacific|asia pacific|greater china|japan|rest of asia pacific|bottling investments)\b",
    "statement": r"\b(revenue|income|equity affiliates|other revenue)\b",
    "auto": r"\b(auto|automotive|energy generation|storage|services)\b",
    "capital": r"\b(equipment)\b",
    "operation": r"\b(operations?)\b",
    "stream": r"\b(upstream|downstream|all other segments)\b",
    "hydrocarbon": r"\b(energy products|chemical products|specialty products|upstream)\b",
    "activity": r"\b(online stores|third party seller services|amazon web services|subscription services|physical stores|other services|advertising services)\b",
    "google_old": r"(google inc\.?|all other segments)",
    "google_new": r"\b(google services|google cloud|google play)\b",
    "health": r"\b(innovative medicine|med tech|medical devices|consumer)\b",
    "machinery": r"\b(machinery energy transportation|financial products)\b",
    "ecosystem": r"\b(smartphones?|iot and lifestyle products|internet services)\b",
    "streaming": r"\b(streaming|dvd)\b",
}


def segment_exception(names: Column) -> Column:
    """Why a quarter's segments (an array of their names) need not sum to the revenue: the first rule that holds, or null. Each rule
    bounds the number of names, asks how many match a pattern, and may ask for a certain name or a part of one."""
    given = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    low = F.transform(given, lambda n: F.lower(n))
    n = F.size(given)
    count = lambda kind: F.size(F.filter(low, lambda x: x.rlike(NAME_PATTERNS[kind])))
    every = lambda kind: count(kind) == n
    part = lambda text: F.exists(low, lambda x: x.contains(text))
    named = lambda text: F.array_contains(low, text)
    words = lambda x: F.size(F.split(F.regexp_replace(x, r"\s+", " "), " "))
    product = F.size(F.filter(low, lambda x: ~x.rlike(NAME_PATTERNS["therapeutic"]) & ~x.rlike(NAME_PATTERNS["component"]) & (words(x) <= 3)))
    upper = F.size(F.filter(given, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 4)))
    rules = [
        (count("product_line") >= 1, "partial-merchandise-category-disclosure"),
        ((n <= 6) & (count("bank") >= F.greatest(F.lit(3), n - 1)), "business-line-revenue-disclosure"),
        ((n <= 4) & every("component"), "partial-revenue-component-disclosure"),
        ((n <= 2) & every("streaming") & named("streaming"), "legacy-business-model-disclosure"),
        ((n <= 4) & every("operation"), "partial-operation-model-disclosure"),
        ((n <= 3) & every("capital"), "capital-bucket-disclosure"),
        ((n <= 3) & every("stream"), "partial-energy-business-disclosure"),
        ((n >= 5) & (count("entity") >= 4) & part("other"), "operating-business-bucket-disclosure"),
        ((n >= 4) & (count("geographic") >= 4) & part("bottling investments"), "partial-geographic-segment-disclosure"),
        ((n <= 4) & (count("statement") >= 2) & (part("equity affiliates") | part("other revenue")), "statement-component-disclosure"),
        ((n >= 5) & every("activity") & part("online stores"), "activity-revenue-line-disclosure"),
        ((n == 3) & every("ecosystem") & named("internet services"), "ecosystem-product-line-disclosure"),
        ((n <= 2) & every("google_old") & part("google inc."), "legacy-core-segment-disclosure"),
        ((n <= 3) & (count("google_new") >= 2) & part("all other segments"), "partial-google-business-disclosure"),
        ((count("google_old") >= 2) & (count("google_new") >= 1) & part("google inc."), "mixed-google-hierarchy-disclosure"),
        ((n <= 4) & every("hydrocarbon") & named("upstream"), "partial-energy-product-disclosure"),
        ((count("therapeutic") >= 2) & (product >= 5), "mixed-hierarchy-product-disclosure"),
        ((n >= 8) & (upper >= 2) & part("other product"), "partial-key-product-disclosure"),
        ((n <= 3) & every("auto") & (part("auto") | (named("services") & named("energy generation & storage"))), "partial-business-line-disclosure"),
        ((n <= 2) & every("health") & named("consumer"), "partial-healthcare-business-disclosure"),
        ((n >= 3) & every("health") & named("consumer"), "mixed-continuing-and-consumer-disclosure"),
        ((n == 2) & every("machinery") & named("financial products"), "industrial-plus-financial-products-disclosure"),
    ]
    return F.coalesce(*(F.when((n >= 2) & holds, name) for holds, name in rules))


def detail_exception(names: Column, target: Column) -> Column:
    """Why the details under a segment need not sum to it, or null; without names or a target there is none."""
    given = F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: n != "")
    parent, n = F.lower(F.trim(target)), F.size(given)
    every = lambda pattern: F.forall(given, lambda x: x.rlike(pattern))
    found = (
        F.when(parent.rlike(r"\bnet (product|service) revenues\b") & (n <= 1), "partial-subcategory-disclosure")
        .when(parent.rlike(r"\bnet system sales\b") & every(r"\b(euv|arfi|arf dry|krf|i-line)\b"), "partial-product-platform-disclosure")
        .when(parent.rlike(r"\b(auto|automotive)\b") & (n <= 2) & every(r"\b(leasing|regulatory credits)\b"), "partial-auto-component-disclosure")
    )
    return F.when((n > 0) & (parent != ""), found)


def adjustment_strengths(df: DataFrame) -> DataFrame:
    """How strongly gains (gains, their sum; n_gains) lift the result (op_income, net, revenue): their ratio to the operating income, the
    share of the net profit that exceeds it, and two measures between 0 and 1 made of both."""
    zero = _zero()
    op, net, total = F.greatest("op_income", zero), F.greatest("net", zero), F.greatest("gains", zero)
    ratio = F.when((total > 0.02) & (op > 0.02), F.try_divide(total, op)).otherwise(0.0)
    more = F.when((total > 0.02) & (F.col("net") > 0.02), F.try_divide(F.greatest(net - op, zero), net)).otherwise(0.0)
    held = lambda x: F.greatest(F.least(x, F.lit(1.0)), zero)
    any_gain = F.col("n_gains") > 0
    scale = F.when(any_gain, held(ratio * 0.58 + more * 0.74 + total / F.greatest("revenue", F.lit(0.05)) * 0.38)).otherwise(0.0)
    extreme = F.when(any_gain, held(F.greatest(ratio - 1.1, zero) / 1.7 + F.greatest(more - 0.45, zero) * 0.6)).otherwise(0.0)
    return df.withColumns({"op_ratio": F.round(ratio, 6), "expansion": F.round(more, 6), "scale": F.round(scale, 6), "extreme": F.round(extreme, 6)})


def overlap(a: Column, b: Column, padding: float = 0.0) -> tuple[Column, Column]:
    """Whether two boxes (left, top, right, bottom) overlap when both are padded, and the area a shares with b padded; nulls are 0."""
    side = lambda box, name: F.coalesce(box[name].cast("double"), _zero())
    apart = (side(a, "right") + padding <= side(b, "left")) | (side(b, "right") + padding <= side(a, "left")) | (side(a, "bottom") + padding <= side(b, "top")) | (side(b, "bottom") + padding <= side(a, "top"))
    width = F.least(side(a, "right"), side(b, "right") + padding) - F.greatest(side(a, "left"), side(b, "left") - padding)
    height = F.least(side(a, "bottom"), side(b, "bottom") + padding) - F.greatest(side(a, "top"), side(b, "top") - padding)
    return ~apart, F.greatest(width, _zero()) * F.greatest(height, _zero())


def rebuild_stale(cached: DataFrame, checked: DataFrame, build: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """M1: the cached rows, but for the keys that are stale (checked: key, stale; a null counts as not stale), which `build` makes anew
    from a table of those keys; what it doesn't make stays cached."""
    return preserve_missing(build(checked.filter(F.coalesce("stale", F.lit(False))).select(key).distinct()), cached, [key])

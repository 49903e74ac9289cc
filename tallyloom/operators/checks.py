"""Validation and audits of statements and breakdowns."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import tolerance

CORE = ["revenue", "cost", "gross", "opex", "op_income", "pretax", "tax", "net"]


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def grade(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def _blend(a: Column, b: Column, share: str) -> Column:
    """share * a + (1 - share) * b of scores of 4 digits, in decimals, so that halves always round up."""
    d = lambda c: c.cast("decimal(9,4)")
    return F.round(d(a) * F.lit(Decimal(share)) + d(b) * F.lit(1 - Decimal(share)), 4).cast("double")


def validation(df: DataFrame) -> DataFrame:
    """H1: eight checks that apply where all their fields are known, each within 3 % (at least 0.12, rates 0.35).

    completeness is the share of core fields, consistency that of checks passed (0.5 if none), issues the codes that failed.
    """
    c = F.col
    rate = lambda part, whole: F.round(F.when(c(whole) != 0, c(part) / c(whole) * 100), 3)
    expected = {
        "revenue-minus-cost-equals-gross": (c("gross"), c("revenue") - c("cost"), 0.12),
        "gross-minus-opex-equals-operating": (c("op_income"), c("gross") - c("opex"), 0.12),
        "operating-plus-nonoperating-equals-pretax": (c("pretax"), c("op_income") + c("non_op"), 0.12),
        "pretax-minus-tax-equals-net": (c("net"), c("pretax") - c("tax"), 0.12),
        "gross-margin-check": (c("gross_margin"), rate("gross", "revenue"), 0.35),
        "operating-margin-check": (c("op_margin"), rate("op_income", "revenue"), 0.35),
        "profit-margin-check": (c("net_margin"), rate("net", "revenue"), 0.35),
        "tax-rate-check": (c("tax_rate"), rate("tax", "pretax"), 0.35),
    }
    passed = {code: F.round(F.abs(F.round(told - derived, 3)), 3) <= tolerance(told, least) for code, (told, derived, least) in expected.items()}
    passed = {code: F.when((expected[code][0] - expected[code][1]).isNotNull(), ok) for code, ok in passed.items()}
    run = _total([ok.isNotNull().cast("int") for ok in passed.values()])
    good = _total([F.coalesce(ok, F.lit(False)).cast("int") for ok in passed.values()])
    known = _total([c(f).isNotNull().cast("int") for f in CORE])
    issues = F.array_join(F.array(*(F.when(~ok, F.lit(code)) for code, ok in passed.items())), ",")
    scored = df.select("company", "q_ord", F.round(known / len(CORE), 4).alias("completeness"), run.alias("checks_run"), good.alias("checks_passed"), issues.alias("issues"))
    scored = scored.withColumn("consistency", F.when(c("checks_run") > 0, F.round(c("checks_passed") / c("checks_run"), 4)).otherwise(0.5))
    scored = scored.withColumn("confidence", F.least(F.lit(1.0), _blend(c("completeness"), c("consistency"), "0.55")))
    return scored.withColumn("grade", grade(c("confidence")))


def company_summary(validated: DataFrame) -> DataFrame:
    """H2: a company's mean confidence, its issues, and its latest quarter's confidence."""
    failed = F.col("checks_run") - F.col("checks_passed")
    sums = validated.groupBy("company").agg(F.count(F.lit(1)).alias("n_quarters"), F.sum(failed).alias("n_issues"), F.count_if(failed > 0).alias("n_mismatch"), F.count_if(F.col("grade") == "high").alias("n_high"), F.round(F.avg("confidence"), 4).alias("confidence"), F.max("q_ord").alias("latest"), F.max_by("confidence", "q_ord").alias("latest_confidence"))
    return sums.withColumn("grade", grade(F.col("confidence")))


def structure(statements: DataFrame, members: DataFrame, details: DataFrame, expenses: DataFrame, financial: DataFrame) -> DataFrame:
    """H3: sums of segments against revenue, of details against their segment, and expenses' overflow, by company.

    Segments and expenses count with two rows or more; a mismatch differs by more than the tolerance. The structural score is the
    mean of the parts' shares without mismatch (0.75 without any part), the overall one 0.35 of that and 0.65 of the statements'.
    """
    keys = ["company", "q_ord"]
    size = F.round(F.sum(F.abs("value")), 3)

    def against(rows: DataFrame, base: DataFrame, on: list[str], least: int, name: str, over_only: bool) -> DataFrame:
        sums = rows.groupBy(*on).agg(size.alias("_sum"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
        delta = F.round(F.col("_sum") - F.col("_base"), 3)
        wrong = (delta if over_only else F.abs(delta)) > tolerance(F.col("_base"))
        return sums.join(base, on).groupBy("company").agg(F.count(F.lit(1)).alias(f"{name}_checks"), F.count_if(wrong).alias(f"{name}_mismatches"))

    revenue = statements.filter(F.col("revenue").isNotNull()).select(*keys, F.col("revenue").alias("_base"))
    opex = statements.filter(F.col("opex").isNotNull()).select(*keys, F.col("opex").alias("_base"))
    parents = members.select(*keys, F.col("member").alias("target"), F.abs("value").alias("_base"))
    parts = [against(members, revenue, keys, 2, "segment", False), against(details, parents, [*keys, "target"], 1, "detail", False), against(expenses, opex, keys, 2, "opex", True)]
    out = financial.select("company", F.col("confidence").alias("_financial"))
    for part in parts:
        out = out.join(part, "company", "left")
    names = ("segment", "detail", "opex")
    out = out.fillna(0, [f"{n}_{k}" for n in names for k in ("checks", "mismatches")])
    rates = [F.when(F.col(f"{n}_checks") > 0, 1 - F.col(f"{n}_mismatches") / F.col(f"{n}_checks")) for n in names]
    n_parts = _total([r.isNotNull().cast("int") for r in rates])
    score = F.when(n_parts > 0, F.round(_total([F.coalesce(r, F.lit(0.0)) for r in rates]) / n_parts, 4)).otherwise(0.75)
    out = out.withColumn("structural", score).withColumn("overall", _blend(F.col("_financial"), F.col("structural"), "0.65"))
    return out.withColumn("grade", grade(F.col("overall"))).drop("_financial")


def quality(df: DataFrame) -> DataFrame:
    """H4: 100 less 14 for each missing of revenue, operating income and net, less 24, 18 and 18 times the whole points that segments',
    costs' and expenses' coverage (at most 1, 4 digits) is below 0.85, 0.75 and 0.75, plus the sources (six at most)."""
    missing = _total([F.col(f).isNull().cast("int") for f in ("revenue", "op_income", "net")])
    shares = {n: F.when(F.col(whole) > 0, F.round(F.least(F.coalesce(F.col(part), F.lit(0.0)) / F.col(whole), F.lit(1.0)), 4)) for n, part, whole in (("segment", "segment_sum", "revenue"), ("cost", "cost_sum", "cost"), ("opex", "opex_sum", "opex"))}
    loss = lambda name, least, weight: F.coalesce(F.floor(F.round(F.greatest(least - shares[name], F.lit(0.0)) * weight, 6)), F.lit(0))
    score = 100 - missing * 14 - loss("segment", 0.85, 24) - loss("cost", 0.75, 18) - loss("opex", 0.75, 18) + F.least(F.col("n_sources"), F.lit(6))
    low = [F.when(shares[n] < least, F.lit(f"{n}-coverage-low")) for n, least in (("segment", 0.85), ("cost", 0.6), ("opex", 0.6))]
    codes = [F.when(missing > 0, F.lit("missing-required")), *low]
    residual = F.when(F.col("revenue") > 0, F.round(F.greatest(F.col("revenue") - F.col("segment_sum"), F.lit(0.0)), 3))
    return df.select("company", "q_ord", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"), shares["segment"].alias("segment_coverage"), residual.alias("residual"), F.array_join(F.array(*codes), ",").alias("issues"))


def degenerate(df: DataFrame, fields: list[str]) -> DataFrame:
    """An entry of which six fields or more (above 0.02) hold one value, with two different values at most."""
    sizes = F.filter(F.array(*(F.round(F.abs(F.col(f)), 3) for f in fields)), lambda v: v > 0.02)
    rows = df.select("company", "q_ord", sizes.alias("_v"), F.array_distinct(sizes).alias("_d"))
    times = F.transform("_d", lambda d: F.size(F.filter("_v", lambda v: v == d)))
    return rows.select("company", "q_ord", ((F.size("_v") >= 6) & (F.size("_d") <= 2) & (F.coalesce(F.array_max(times), F.lit(0)) >= 6)).alias("degenerate"))


def renderable(df: DataFrame) -> DataFrame:
    """Quarters with revenue above 0.05 and any of gross, cost, operating income, net and tax; all of a company's if none is."""
    good = (F.col("revenue") > 0.05) & F.coalesce("gross", "cost", "op_income", "net", "tax").isNotNull()
    marked = df.withColumn("_good", F.coalesce(good, F.lit(False)))
    marked = marked.withColumn("_any", F.max("_good").over(Window.partitionBy("company")))
    return marked.filter(F.col("_good") | ~F.col("_any")).drop("_good", "_any")


def low_quality(df: DataFrame) -> DataFrame:
    """Entries with fewer than two of revenue, operating income and net, and neither tax nor pretax, unless a summary."""
    core = _total([F.col(f).isNotNull().cast("int") for f in ("revenue", "op_income", "net")])
    return df.withColumn("low_quality", ~F.col("is_summary") & (core < 2) & F.col("tax").isNull() & F.col("pretax").isNull())


def audit(summary: DataFrame, least_quarters: int) -> DataFrame:
    """H6: each company's blocking issues, one a row; companies without any give none."""
    issues = F.array(F.when(F.col("n_quarters") < least_quarters, F.lit("short-history")), F.when(F.col("lag") > 0, F.lit("stale")), F.when(F.col("n_missing") > 0, F.lit("gaps")))
    return summary.select("company", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def isolated_schemas(members: DataFrame) -> DataFrame:
    """H7: quarters whose members differ from those of both neighbouring rows, which agree with each other."""
    sets = members.groupBy("company", "q_ord").agg(F.array_join(F.array_sort(F.collect_set("member")), "|").alias("signature"))
    order = Window.partitionBy("company").orderBy("q_ord")
    near = sets.withColumn("_before", F.lag("signature").over(order)).withColumn("neighbours", F.lead("signature").over(order))
    return near.filter((F.col("_before") == F.col("neighbours")) & (F.col("signature") != F.col("neighbours"))).drop("_before")


def synthetic_residuals(rows: DataFrame) -> DataFrame:
    """H7: quarters with a residual row (otherrevenue) that no official group gave, and its share of the revenue (3 digits)."""
    made = rows.filter((F.col("member") == "otherrevenue") & ~F.coalesce(F.col("source") == "official-groups", F.lit(False)))
    return made.select("company", "q_ord", F.round(F.col("value") / F.greatest(F.coalesce("revenue", F.lit(0.0)), F.lit(0.001)), 3).alias("residual_share"))


def classification(entries: DataFrame, policies: DataFrame) -> DataFrame:
    """H5: a company's quarters with revenue and with expense classification (has_revenue, has_expense), the latest of each, their lags
    behind the newest quarter, shares, warnings, blockers and status.

    Policies (company, gap_allowed, gap_reason, need_expense, expense_gap_allowed): null flags mean no. A newest quarter without revenue
    classification blocks, unless a gap is allowed with a reason (a warning); one without expenses blocks where they are needed and no gap
    is allowed. Fewer than four classified quarters of more (or than there are) warn, as does none. The status is the first of error (any
    blocker), exception (an allowed revenue gap), warning and ok.
    """
    own = entries.groupBy("company").agg(
        F.count(F.lit(1)).alias("n_quarters"), F.max("q_ord").alias("latest"),
        F.count_if("has_revenue").alias("n_revenue"), F.count_if("has_expense").alias("n_expense"),
        F.max(F.when(F.col("has_revenue"), F.col("q_ord"))).alias("latest_revenue"), F.max(F.when(F.col("has_expense"), F.col("q_ord"))).alias("latest_expense"),
    )
    both = own.join(policies, "company", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    no_revenue = ~F.coalesce(F.col("latest_revenue") == F.col("latest"), F.lit(False))
    no_expense = ~F.coalesce(F.col("latest_expense") == F.col("latest"), F.lit(False))
    excused = flag("gap_allowed") & (F.trim(F.coalesce("gap_reason", F.lit(""))) != "")
    blocking = flag("need_expense") & ~flag("expense_gap_allowed")
    few = lambda c: (F.col(c) > 0) & (F.col(c) < F.least("n_quarters", F.lit(4)))
    listed = lambda *rules: F.filter(F.array(*(F.when(cond, F.lit(name)) for cond, name in rules)), lambda x: x.isNotNull())
    blockers = listed((no_revenue & ~excused, "latest-revenue-missing"), (no_expense & blocking, "latest-expense-missing"))
    warnings = listed((no_revenue & excused, "latest-revenue-gap"), (few("n_revenue"), "sparse-revenue"), (few("n_expense"), "sparse-expense"), (F.col("n_revenue") == 0, "no-revenue"), (flag("need_expense") & (F.col("n_expense") == 0), "no-expense"))
    status = F.when(F.size(blockers) > 0, "error").when(flag("gap_allowed") & no_revenue, "exception").when(F.size(warnings) > 0, "warning").otherwise("ok")
    share = lambda c: F.round(F.col(c) / F.col("n_quarters"), 4)
    return both.select("company", "n_quarters", "latest", "n_revenue", "n_expense", "latest_revenue", "latest_expense", share("n_revenue").alias("revenue_share"), share("n_expense").alias("expense_share"), (F.col("latest") - F.col("latest_revenue")).alias("revenue_lag"), (F.col("latest") - F.col("latest_expense")).alias("expense_lag"), F.array_join(warnings, ",").alias("warnings"), F.array_join(blockers, ",").alias("blockers"), status.alias("status"))

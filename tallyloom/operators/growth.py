"""Growth and mix: positional and calendar lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _percent(now: Column, then: Column, digits: int) -> Column:
    return F.round((now / then - 1) * 100, digits)


#: Margins whose changes in a year are taken where a frame has them.
MARGINS = ("gross_margin", "op_margin", "net_margin")


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def positional(df: DataFrame) -> DataFrame:
    """G1: qoq and yoy against the rows one and four places before, whatever quarters they are; not where either is null or 0.

    With a column net also net_yoy, with margins (gross_margin, op_margin, net_margin) their changes in points, all to 2 digits. What is
    computed takes the place of a given figure; where nothing can be, that stays.
    """
    order = Window.partitionBy("company").orderBy("q_ord")
    out = df
    for name, value, back in (("qoq", "revenue", 1), ("yoy", "revenue", 4), ("net_yoy", "net", 4)):
        if value in df.columns:
            then = F.lag(value, back).over(order)
            out = out.withColumn(name, F.coalesce(F.when((then != 0) & (F.col(value) != 0), _percent(F.col(value), then, 2)), _given(df, name)))
    for margin in MARGINS:
        if margin in df.columns:
            out = out.withColumn(f"{margin}_delta", F.coalesce(F.round(F.col(margin) - F.lag(margin, 4).over(order), 2) + F.lit(0.0), _given(df, f"{margin}_delta")))
    return out


def calendar(df: DataFrame, overwrite: bool) -> DataFrame:
    """qoq and yoy against the calendar quarters one and four before, to 3 digits.

    Filling (G2) takes any prior but 0, leaves given figures as they are, and fills net_yoy with a column net and the changes of
    margins in points with those. Overwriting (G4) wants both revenues above 0, and a given figure goes where one isn't.
    """
    values = [c for c in ("revenue", "net", *MARGINS) if c in df.columns]
    then_of = lambda c, back: F.max(c).over(Window.partitionBy("company").orderBy("q_ord").rangeBetween(-back, -back))
    out = df.withColumns({f"_{c}_{back}": then_of(c, back) for c in values for back in (1, 4)})  # one sort serves all
    for name, value, back in (("qoq", "revenue", 1), ("yoy", "revenue", 4), *([] if overwrite else [("net_yoy", "net", 4)])):
        if value in values:
            now, then = F.col(value), F.col(f"_{value}_{back}")
            figure = F.when((then > 0) & (now > 0) if overwrite else then != 0, _percent(now, then, 3))
            out = out.withColumn(name, figure if overwrite else F.coalesce(_given(df, name), figure))
    for margin in [] if overwrite else MARGINS:
        if margin in values:
            out = out.withColumn(f"{margin}_delta", F.coalesce(_given(df, f"{margin}_delta"), F.round(F.col(margin) - F.col(f"_{margin}_4"), 3) + F.lit(0.0)))
    return out.drop(*(f"_{c}_{back}" for c in values for back in (1, 4)))


def mix(df: DataFrame) -> DataFrame:
    """members' shares of their quarter (1 digit), their change in a year in points, growth in a year and a quarter (2 digits).

    Shares are of the quarter's revenue, or of its members' sum without such a column. Rows of mode "share" tell a share in mix_pct, or
    in value where that is null or 0; with revenue their value is worked out first (3 digits). Given mix_pct, mix_delta, yoy and qoq
    stay; where suppress_qoq is true no qoq is filled. A null value counts as 0, priors of 0 give nothing.
    """
    total = F.col("revenue") if "revenue" in df.columns else F.sum("value").over(Window.partitionBy("company", "q_ord"))
    mode = F.col("mode") if "mode" in df.columns else F.lit(None)
    quiet = F.coalesce(F.col("suppress_qoq"), F.lit(False)) if "suppress_qoq" in df.columns else F.lit(False)
    told = F.coalesce(F.when(_given(df, "mix_pct") != 0, _given(df, "mix_pct")), F.col("value"), F.lit(0.0))
    rows = df.withColumn("_total", F.when(total != 0, total)).withColumn("_told", F.when((mode == "share") & F.col("_total").isNotNull(), told))
    rows = rows.withColumn("value", F.when(F.col("_told").isNotNull(), F.round(F.col("_told") / 100 * F.col("_total"), 3)).otherwise(F.col("value")))
    rows = rows.withColumn("_now", F.coalesce("value", F.lit(0.0))).withColumn("_share", 100 * F.col("_now") / F.col("_total"))
    keys = ["company", "q_ord", "member"]
    year = rows.select("company", (F.col("q_ord") + 4).alias("q_ord"), "member", F.when(F.col("_now") != 0, F.col("_now")).alias("_year"), F.col("_share").alias("_year_share"))
    quarter = rows.select("company", (F.col("q_ord") + 1).alias("q_ord"), "member", F.when(F.col("_now") != 0, F.col("_now")).alias("_quarter"))
    change = F.when(F.col("_year").isNotNull(), F.round(F.col("_share") - F.col("_year_share"), 1) + F.lit(0.0))
    return rows.join(year, keys, "left").join(quarter, keys, "left").select(
        *keys,
        "value",
        F.coalesce(F.round("_told", 1), _given(df, "mix_pct"), F.round("_share", 1)).alias("mix_pct"),
        F.coalesce(_given(df, "mix_delta"), change).alias("mix_delta"),
        F.coalesce(_given(df, "yoy"), _percent(F.col("_now"), F.col("_year"), 2)).alias("yoy"),
        F.coalesce(_given(df, "qoq"), F.when(~quiet, _percent(F.col("_now"), F.col("_quarter"), 2))).alias("qoq"),
    )


def gap_audit(df: DataFrame) -> DataFrame:
    """Rows and missing growth figures of each company."""
    return df.groupBy("company").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("qoq").isNull()).alias("no_qoq"), F.count_if(F.col("yoy").isNull()).alias("no_yoy"))


def margin_deltas(df: DataFrame) -> DataFrame:
    """Qoq against the calendar quarter before and the margin's change in a year in points, both to 3 digits."""
    prior = df.select("company", (F.col("q_ord") + 1).alias("q_ord"), F.col("revenue").alias("_then"))
    year = df.select("company", (F.col("q_ord") + 4).alias("q_ord"), F.col("margin").alias("_margin"))
    both = df.join(prior, ["company", "q_ord"], "left").join(year, ["company", "q_ord"], "left")
    return both.select(*df.columns, F.when(F.col("_then") != 0, _percent(F.col("revenue"), F.col("_then"), 3)).alias("qoq"), F.round(F.col("margin") - F.col("_margin"), 3).alias("margin_delta"))


def fx_adjusted(df: DataFrame) -> DataFrame:
    """Growth in a year (column yoy) in the display currency, by the quarters' scales; as it is where a scale is missing."""
    year = df.select("company", (F.col("q_ord") + 4).alias("q_ord"), F.col("scale").alias("_scale"))
    adjusted = F.round(((1 + F.col("yoy") / 100) * F.col("scale") / F.col("_scale") - 1) * 100, 3)
    return df.join(year, ["company", "q_ord"], "left").withColumn("yoy_adjusted", F.when(F.col("_scale") > 0, F.coalesce(adjusted, F.col("yoy"))).otherwise(F.col("yoy"))).drop("_scale")


def weighted_mean(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The metric's mean weighted by value, to 1 digit; rows without it count in the weights all the same."""
    return df.groupBy(*keys).agg((F.round(F.sum(F.col("value") * F.col(metric)) / F.sum("value"), 1) + F.lit(0.0)).alias(metric))

"""Parts and their totals: fitting, top-k with the rest, stacking, alignment, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_to_total(df: DataFrame) -> DataFrame:
    """Values scaled to the quarter's total (3 digits); the last member takes the remainder, so sums agree."""
    whole = Window.partitionBy("company", "q_ord")
    order = whole.orderBy("member")
    scaled = df.withColumn("_scaled", F.round(F.col("value") * F.col("total") / F.sum("value").over(whole), 3))
    before = F.coalesce(F.sum("_scaled").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    last = F.row_number().over(order) == F.count(F.lit(1)).over(whole)
    return scaled.withColumn("fitted", F.round(F.when(last, F.col("total") - before).otherwise(F.col("_scaled")), 3)).drop("_scaled")


def top_k_other(df: DataFrame, k: int) -> DataFrame:
    """The k largest members of each group, and all others as one."""
    rank = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("value"), "member"))
    return df.withColumn("member", F.when(rank <= k, F.col("member")).otherwise("other")).groupBy("company", "member").agg(F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("n_members"))


def stack(df: DataFrame) -> DataFrame:
    """Start and end of each member in its quarter's bar, largest first."""
    order = Window.partitionBy("company", "q_ord").orderBy(F.desc("value"), "member").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("end", F.round(F.sum("value").over(order), 3)).withColumn("start", F.round(F.sum("value").over(order) - F.col("value"), 3) + F.lit(0.0))


def alignment(df: DataFrame, least: float = 0.58) -> DataFrame:
    """How like each quarter's members are to those of the company's latest quarter: Jaccard similarity and whether it is enough."""
    sets = df.groupBy("company", "q_ord").agg(F.collect_set("member").alias("own"))
    anchor = sets.groupBy("company").agg(F.max_by("own", "q_ord").alias("anchor"))
    score = F.size(F.array_intersect("own", "anchor")) / F.size(F.array_union("own", "anchor"))
    return sets.join(anchor, "company").select("company", "q_ord", F.size("own").cast("long").alias("n_members"), F.round(score, 6).alias("jaccard"), (score >= least).alias("comparable"))


#: Member keys that stand for a category rather than a disclosure.
PLACEHOLDERS = ("finance_expense", "financeexpense", "fulfillment", "ga", "general_administrative", "generaladministrative", "rd", "rnd", "sales_marketing", "salesmarketing", "taxes_surcharges", "taxessurcharges")


def suspicious(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a breakdown (member, value, total) of four members or more is no real one.

    It is if all are near zero; or if one value above 0.02 repeats four times and at least four different placeholder members
    hold it, or it or the sum is far above the total (without a total: if there is no other value). Values compare by
    magnitude, to 3 digits; of values that repeat equally often the largest counts.
    """
    size = F.round(F.abs("value"), 3)
    holder = F.when(F.col("member").isin(*PLACEHOLDERS), F.regexp_replace("member", "_", ""))
    by_value = df.groupBy(*keys, size.alias("_v")).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("value") > 0.02).alias("_n"), F.countDistinct(holder).alias("_holders"), F.max("total").alias("_total"))
    above = F.col("_n") > 0
    groups = by_value.groupBy(*keys).agg(F.sum("_all").alias("n_members"), F.max("_v").alias("_most"), F.sum("_n").alias("_above"), F.max(F.when(above, F.struct("_n", "_v", "_holders"))).alias("_modal"), F.count_if(above).alias("_different"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"), F.max("_total").alias("_total"))
    total = F.coalesce("_total", F.lit(0.0))
    far = (F.col("_modal._v") > total * 1.08 + F.greatest(total * 0.01, F.lit(0.12))) | (F.col("_sum") > total * 1.35 + F.greatest(total * 0.03, F.lit(0.35)))
    echoes = (F.col("_above") >= 4) & (F.col("_modal._n") >= 4) & ((F.col("_modal._holders") >= 4) | F.when(total <= 0, F.col("_different") <= 1).otherwise(far))
    odd = (F.col("n_members") >= 4) & ((F.col("_most") <= 0.02) | F.coalesce(echoes, F.lit(False)))
    return groups.select(*keys, "n_members", odd.alias("suspicious"))


def coverage(df: DataFrame) -> DataFrame:
    """Quarters each company has, its first and last, how many are missing between, and how far it lags behind the newest of all."""
    own = df.groupBy("company").agg(F.count(F.lit(1)).alias("n_quarters"), F.min("q_ord").alias("first_q"), F.max("q_ord").alias("last_q"))
    newest = df.agg(F.max("q_ord")).scalar()
    return own.select("company", "n_quarters", "first_q", "last_q", (F.col("last_q") - F.col("first_q") + 1 - F.col("n_quarters")).alias("n_missing"), (newest - F.col("last_q")).alias("lag"))

"""Details under segments, groups of members, observations near each other, and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import labels
from tallyloom.operators.merging import attach

#: Targets that are always shown in detail.
PRIORITY_TARGETS = ("products", "product", "adrevenue")
#: Rows of a quarter at most, once a segment is shown in detail.
MOST_ROWS = 7


def label_penalty(label: Column) -> Column:
    """How much speaks against a label: 220 for aggregation, reportable or consolidated, 200 for "before other operating", 32 for "all
    other segments", 18 for corporate beside other, 110 for an aggregate label."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "&", " and "), "[^a-z0-9]+", " "))
    rules = ((plain.rlike("aggregation|reportable|consolidated"), 220), (plain.rlike("before other operating"), 200), (plain.rlike("all other segments"), 32), (plain.rlike("corporate .* other|other .* corporate"), 18), (labels.aggregate_like(plain), 110))
    total = F.lit(0)
    for holds, points in rules:
        total = total + F.when(holds, points).otherwise(0)
    return total


def expand_details(rows: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """A quarter's rows (member, value), of which a segment gives way to its details (target, member, value), if two or more above 0.02
    that are no aggregates sum to 0.72 to 1.08 of it, the quarter has at most seven rows then, and the segment is a priority target, or an
    aggregate label of 0.28 of the quarter or more with three details or more. Quarters with fewer than two details stay as they are.

    Segments are taken in order of their names, as each that is expanded leaves less room for the next; `target` names the expanded one.
    """
    real = details.filter(F.col("value") > 0.02)
    per = Window.partitionBy(*keys)
    usable = real.withColumn("_all", F.count(F.lit(1)).over(per)).filter((F.col("_all") >= 2) & ~labels.aggregate_like(F.col("member")))
    groups = usable.groupBy(*keys, "target").agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    own = rows.withColumn("_total", F.sum("value").over(per)).withColumn("_rows", F.count(F.lit(1)).over(per))
    ratio, share = F.col("_sum") / F.greatest("value", F.lit(0.001)), F.col("value") / F.greatest("_total", F.lit(0.001))
    wanted = F.regexp_replace(F.lower("member"), "[^a-z0-9]", "").isin(*PRIORITY_TARGETS) | (labels.aggregate_like(F.col("member")) & (F.col("_n") >= 3) & (share >= 0.28))
    fits = own.join(groups.withColumnRenamed("target", "member"), [*keys, "member"]).filter((F.col("value") > 0.02) & ratio.between(0.72, 1.08) & wanted)
    # a quarter has few such segments: fold them, as long as there is room
    folded = fits.groupBy(*keys).agg(F.max("_rows").alias("_rows"), F.array_sort(F.collect_list(F.struct("member", "_n"))).alias("_fits"))
    start = F.struct(F.col("_rows").alias("n"), F.array().cast("array<string>").alias("taken"))

    def step(state: Column, f: Column) -> Column:
        more = state["n"] - 1 + f["_n"]
        room = more <= MOST_ROWS
        return F.struct(F.when(room, more).otherwise(state["n"]).alias("n"), F.when(room, F.concat(state["taken"], F.array(f["member"]))).otherwise(state["taken"]).alias("taken"))

    taken = folded.select(*keys, F.explode(F.aggregate("_fits", start, step)["taken"]).alias("target"))
    left = rows.join(taken.withColumnRenamed("target", "member"), [*keys, "member"], "left_anti").select(*keys, "member", "value", F.lit(None).cast("string").alias("target"))
    return left.unionByName(usable.join(taken, [*keys, "target"]).select(*keys, "member", "value", "target"))


def regroup(rows: DataFrame, groups: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """members (member, value and a metric such as growth) under the parents that a table names (style, member, parent), for rows of that
    style: values sum, the metric's mean is weighted by value (G8, 1 digit; members without it count in the weights). Members without a
    parent stay under their own name."""
    named = rows.join(groups.select("style", "member", "parent"), ["style", "member"], "left").withColumn("member", F.coalesce("parent", "member"))
    weighted = F.sum(F.col("value") * F.col(metric))
    return named.groupBy(*keys, "member").agg(F.round(F.sum("value"), 3).alias("value"), (F.round(F.try_divide(weighted, F.sum("value")), 1) + F.lit(0.0)).alias(metric), F.count(F.lit(1)).alias("n_members"))


def nearest_below(anchors: DataFrame, observations: DataFrame, most_dx: float = 0.045, most_dy: float = 0.06) -> DataFrame:
    """For each anchor (page, anchor, x, y) the percentage (page, text, x, y) that stands nearest below it on its page: y points up, up
    to most_dx aside and most_dy below, the smallest of dy + 0.6 dx, of equal ones the first text; null if there is none.

    Observations are offered to the cells of a grid as wide as the reach, so an anchor meets those in nine cells alone.
    """
    shown = observations.filter(F.col("text").rlike(r"^\s*\(?[-+]?\d+(?:\.\d+)?\s*%\)?\s*$"))
    cell = lambda c, size: F.floor(c / size).cast("long")
    aside, below = F.explode(F.sequence(F.lit(-1), F.lit(1))), F.explode(F.sequence(F.lit(-1), F.lit(0)))
    own = anchors.withColumn("_i", aside).withColumn("_j", below).withColumn("_cx", cell(F.col("x"), most_dx) + F.col("_i")).withColumn("_cy", cell(F.col("y"), most_dy) + F.col("_j"))
    there = shown.select("page", "text", F.col("x").alias("_x"), F.col("y").alias("_y"), cell(F.col("x"), most_dx).alias("_cx"), cell(F.col("y"), most_dy).alias("_cy"))
    dx, dy = F.abs(F.col("x") - F.col("_x")), F.col("y") - F.col("_y")
    near = own.join(there, ["page", "_cx", "_cy"]).filter((dx <= most_dx) & (dy > 0) & (dy <= most_dy))
    best = near.groupBy("page", "anchor").agg(F.min_by("text", F.struct(F.round(dy + 0.6 * dx, 9), "text")).alias("text"))
    return anchors.select("page", "anchor").join(best, ["page", "anchor"], "left")


def backfill(dataset: DataFrame, history: DataFrame) -> DataFrame:
    """M4: the dataset's quarters with the segments of a history (company, q_ord, rows) that has any for them; quarters that the dataset
    lacks are not added."""
    return attach(dataset, history.withColumn("display_revenue", F.lit(None).cast("double")), "inner").drop("source")


def comparable(rows: DataFrame, phases: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """a quarter's members (company, member, value, filed) above 0.02 as segments that compare across phases of a company's naming.

    A quarter is in the first phase (company, phase, phase_order, any_of, all_of: arrays of members) of which it holds any marker of the
    one kind and all of the other. The phase's members (company, phase, member, segment) sum up by segment (3 digits), with the newest
    filing date; quarters without a phase, and members that a phase doesn't name, go. Phases are joined by company.
    """
    real = rows.withColumn("value", F.round("value", 3)).filter(F.col("value") > 0.02)
    sets = real.groupBy(*keys).agg(F.collect_set("member").alias("_all"))
    fits = sets.join(phases, "company").filter(F.arrays_overlap("any_of", "_all") & (F.size(F.array_except("all_of", "_all")) == 0))
    phase = fits.groupBy(*keys).agg(F.min_by("phase", "phase_order").alias("phase"))
    named = real.join(phase, keys).join(mapping, ["company", "phase", "member"])
    return named.groupBy(*keys, "phase", "segment").agg(F.round(F.sum("value"), 3).alias("value"), F.max("filed").alias("filed"))


def styled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The style of each row (company, style, members: array): its own, else that of the company's first rule (company, rule_order,
    needs: array, rule_style) of which it holds all members; else null."""
    found = rows.join(rules, "company", "left").withColumn("_fits", F.size(F.array_except("needs", "members")) == 0)
    best = F.min_by("rule_style", F.when(F.col("_fits"), F.col("rule_order")))
    keys = [c for c in rows.columns if c not in ("style", "members")]
    inferred = found.groupBy(*keys).agg(F.first("style").alias("_own"), F.when(F.max("_fits"), best).alias("_inferred"))
    own = F.when(F.trim(F.coalesce("_own", F.lit(""))) != "", F.col("_own"))
    return inferred.select(*keys, F.coalesce(own, "_inferred").alias("style"))


def best_page(pages: DataFrame, weights: dict[str, int], key: str) -> DataFrame:
    """Of each document's pages (page, text, from_text) the one that most speaks for holding the figures: the weights of the patterns in
    its text (any case, white space as one blank) add up; of equal ones text goes before what was read off an image, then the earlier
    page. Documents whose pages score nothing give none."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    score = F.lit(0)
    for pattern, weight in weights.items():
        score = score + F.when(plain.rlike(pattern), weight).otherwise(0)
    scored = pages.withColumn("score", score).filter(F.col("score") > 0)
    best = scored.groupBy(key).agg(F.min_by(F.struct("page", "score"), F.struct(-F.col("score"), ~F.col("from_text"), "page")).alias("_b"))
    return best.select(key, "_b.page", F.col("_b.score").cast("long").alias("score"))


def translated(rows: DataFrame, dictionary: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """A label in the other language: the dictionary's (label, translation) for it, compared in lower case without blanks around; else
    with the phrases in it replaced, in the order given, if any is there; else the label itself."""
    plain = lambda c: F.lower(F.trim(c))
    known = dictionary.groupBy(plain(F.col("label")).alias("_key")).agg(F.min("translation").alias("_known"))
    replaced = F.col("label")
    for phrase, other in phrases.items():
        replaced = F.regexp_replace(replaced, f"(?i){phrase}", other)
    return rows.withColumn("_key", plain(F.col("label"))).join(known, "_key", "left").withColumn("translation", F.coalesce("_known", replaced)).drop("_key", "_known")


class Partitions:
    """M3: a dataset written by company, of which each company is read when it is asked for, and once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._read = spark, path, {}

    @staticmethod
    def write(df: DataFrame, path: str) -> None:
        df.repartition("company").write.mode("overwrite").partitionBy("company").parquet(path)

    def company(self, company: int) -> DataFrame:
        """The rows of one company; the filter prunes the scan to its folder."""
        if company not in self._read:
            self._read[company] = self.spark.read.parquet(self.path).filter(F.col("company") == company)
        return self._read[company]

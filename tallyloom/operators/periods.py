"""Period algebra: cumulative to single quarters, contiguous tails, identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.keys import ascii_key
from tallyloom.functions.scalars import member_label, signature
from tallyloom.operators import labels

#: The days of direct and of cumulated facts, the first quarter kept, and forms by the span they suit.
DIRECT_DAYS = (45, 120)
CUMULATED_DAYS = (121, 390)
FIRST_QUARTER = 2018 * 4
QUARTER_FORMS = ("10-Q", "10Q", "6-K", "6K")
ANNUAL_FORMS = ("10-K", "10K", "20-F", "20F", "40-F", "40F")


def cumulative(df: DataFrame) -> DataFrame:
    """Year-to-date revenue of each quarter."""
    year = Window.partitionBy("company", F.floor(F.col("q_ord") / 4)).orderBy("q_ord")
    return df.select("company", "q_ord", F.round(F.sum("revenue").over(year), 3).alias("ytd"))


def single_quarters(df: DataFrame) -> DataFrame:
    """Year-to-date less that of the quarter before in the same year; the first quarter is itself; a gap before gives null."""
    year = Window.partitionBy("company", F.floor(F.col("q_ord") / 4)).orderBy("q_ord")
    before = F.when(F.lag("q_ord").over(year) == F.col("q_ord") - 1, F.lag("ytd").over(year))
    value = F.when(F.col("q_ord") % 4 == 0, F.col("ytd")).otherwise(F.round(F.col("ytd") - before, 3))
    return df.withColumn("value", value).withColumn("derived", F.col("q_ord") % 4 != 0)


def contiguous_tail(df: DataFrame, least: int = 4) -> DataFrame:
    """The latest run of quarters without a gap, where it has `least` or more and is shorter than all; else all."""
    order = Window.partitionBy("company").orderBy("q_ord")
    runs = df.withColumn("_run", F.col("q_ord") - F.row_number().over(order))
    sizes = runs.groupBy("company", "_run").agg(F.count(F.lit(1)).alias("_size"))
    last = sizes.groupBy("company").agg(F.max(F.struct("_run", "_size")).alias("_last"))
    kept = (F.col("_last._size") < least) | (F.col("_run") == F.col("_last._run"))
    return runs.join(last, "company").filter(kept).drop("_run", "_last")


def identities(df: DataFrame) -> DataFrame:
    """Fills gross, cost, operating income, opex, pretax and net from each other, in this order, where they are null."""
    steps = {
        "gross": F.col("revenue") - F.col("cost"),
        "cost": F.col("revenue") - F.col("gross"),
        "op_income": F.col("gross") - F.col("opex"),
        "opex": F.col("gross") - F.col("op_income"),
        "net": F.col("pretax") - F.col("tax"),
        "pretax": F.col("net") + F.col("tax"),
    }
    for name, value in steps.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.round(value, 3)))
    return df.withColumn("gross_margin", F.when(F.col("revenue") != 0, F.round(100 * F.col("gross") / F.col("revenue"), 3)))


def merge_periods(entries: DataFrame) -> DataFrame:
    """One value for each (company, q_ord, span): the highest mode's (direct 2, derived 1), then the last filed; nulls only fill."""
    best = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("mode", "filed")))
    return entries.groupBy("company", "q_ord", "span").agg(best.alias("value"))


def finalize(entries: DataFrame) -> DataFrame:
    """single quarters from entries of one to four quarters' span, in order of quarters and spans.

    A span of one stands. A longer one gives its last quarter less the span one shorter that ends a quarter before, where there is
    one; else less all quarters before it in the span, which must be known. Results below -0.001 are rejected; a quarter that is
    known stays. A company's entries, at most four a quarter, are folded in one row.
    """
    by_company = entries.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("q_ord", "span", "value"))).alias("_all"))
    state = "map<bigint,struct<value:double,derived:boolean>>"
    known = F.map_from_entries(F.transform("_all", lambda e: F.struct(e["q_ord"] * 8 + e["span"], e["value"])))

    def step(done, e):
        q, span = e["q_ord"], e["span"]
        shorter = F.try_element_at(known, (q - 1) * 8 + span - 1)
        before = F.transform(F.slice(F.sequence(q - span + 1, q), F.lit(1), (span - 1).cast("int")), lambda p: F.try_element_at(done, p)["value"])
        total = F.aggregate(before, F.lit(0.0), lambda a, b: a + b)
        single = F.when(span <= 1, e["value"]).otherwise(F.round(e["value"] - F.coalesce(shorter, total), 3) + F.lit(0.0))
        good = single.isNotNull() & F.try_element_at(done, q).isNull() & ((span <= 1) | (single >= -0.001))
        return F.when(good, F.map_concat(done, F.create_map(q, F.struct(single.alias("value"), (span > 1).alias("derived"))))).otherwise(done)

    folded = by_company.select("company", F.aggregate("_all", F.map_from_arrays(F.array(), F.array()).cast(state), step).alias("_done"))
    return folded.select("company", F.explode("_done").alias("q_ord", "_e")).select("company", "q_ord", "_e.value", "_e.derived")


def member_quarters(cumulated: DataFrame, direct: DataFrame) -> DataFrame:
    """members' last quarter of a longer span, less their direct values of the quarters before.

    A record of which any member lacks any such quarter gives nothing; members known directly stay as they are.
    """
    record = ["company", "q_ord"]
    priors = cumulated.filter(F.col("span") > 1).withColumn("_q", F.explode(F.sequence(F.col("q_ord") - F.col("span") + 1, F.col("q_ord") - 1)))
    known = direct.select("company", F.col("q_ord").alias("_q"), "member", F.col("value").alias("_v"))
    sums = priors.join(known, ["company", "_q", "member"], "left").groupBy(*record, "span", "member", "value").agg(F.count("_v").alias("_n"), F.sum("_v").alias("_sum"))
    whole = sums.withColumn("_least", F.min(F.col("_n") - F.col("span")).over(Window.partitionBy(*record))).filter(F.col("_least") == -1)
    return whole.join(direct.select(*record, "member"), [*record, "member"], "left_anti").select(*record, "member", (F.round(F.col("value") - F.col("_sum"), 3) + F.lit(0.0)).alias("value"))


def uncovered(cumulated: DataFrame, facts: DataFrame) -> DataFrame:
    """The rest of a cumulated fact (company, start, end, value) that facts inside it leave, where these are as many as its days ask.

    Inside means from its start and ending before its end; their number is its days over 91, rounded half to even, less one, and at
    least one. The rest begins the day after the last of them. Facts meet cumulated ones by the quarter they start in.
    """
    quarter = lambda d: (F.year(d) * 4 + F.quarter(d) - 1).cast("long")
    spread = cumulated.withColumn("_q", F.explode(F.sequence(quarter("start"), quarter("end"))))
    inside = facts.select("company", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("value").alias("_v"), quarter("start").alias("_q"))
    both = spread.join(inside, ["company", "_q"]).filter((F.col("_s") >= F.col("start")) & (F.col("_e") < F.col("end")))
    sums = both.groupBy("company", "start", "end", "value").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_sum"), F.max("_e").alias("_last"))
    asked = F.greatest(F.bround((F.datediff("end", "start") + 1) / 91) - 1, F.lit(1))
    return sums.filter(F.col("_n") == asked).select("company", F.date_add("_last", 1).alias("start"), "end", (F.round(F.col("value") - F.col("_sum"), 3) + F.lit(0.0)).alias("value"))


def _days(f: Column) -> Column:
    return F.datediff(f["end"], f["start"]) + 1


def _timely(f: Column) -> tuple[Column, Column]:
    """Whether a fact was filed within 210 days of its end, and the days, fewer first; unknown days count as 9,999."""
    gap = F.coalesce(F.datediff(f["filed"], f["end"]), F.lit(9999))
    return gap.between(0, 210), -F.greatest(gap, F.lit(0))


def concept_rank(f: Column) -> list[Column]:
    timely, near = _timely(f)
    return [timely, near, f["namespace_priority"], f["concept_priority"], f["filed"], f["accession"]]


def field_rank(f: Column) -> list[Column]:
    timely, near = _timely(f)
    return [timely, f["concept_priority"], f["namespace_priority"], near, f["filed"]]


def segment_rank(f: Column) -> list[Column]:
    lag, days, form = F.datediff(f["filed"], f["end"]), _days(f), F.regexp_replace(F.upper(f["form"]), " ", "")
    bucket = F.when(lag.isNull(), 1).when(lag < -2, 0).when(lag <= 220, 5).when(lag <= 450, 4).when(lag <= 720, 3).otherwise(2)
    usual = F.when(lag <= 220, 45).when(lag <= 450, 120).when(lag <= 720, 240).otherwise(360)
    near = F.when(lag.isNull() | (lag < -2), -9999).otherwise(-F.abs(lag - usual))
    quarterly, own, other = days.between(*DIRECT_DAYS), form.isin(*QUARTER_FORMS), form.isin(*ANNUAL_FORMS)
    suits = F.when((quarterly & own) | (~quarterly & other), 3).when(own | other, 2).otherwise(1)
    return [f["concept_priority"], suits, bucket, near, -F.abs(days - 91), f["filed"]]


def _derived(facts: DataFrame, keys: list[str], rank: Callable[[Column], list[Column]], least: int | None) -> DataFrame:
    """Direct facts, and what each cumulated fact leaves of itself beyond the direct and derived facts inside it.

    Of facts of one class and end the best by rank stays, then the shortest, then by accession and value. Cumulated facts are folded in
    order of their ends: what one needs ends before it, so a second pass would find nothing more. `least` bounds a derived fact's
    priority from below. A key's facts, at most two an end, are folded in one row.
    """
    f = F.col("_f")
    kept = [c for c in facts.columns if c not in keys]
    days = F.datediff("end", "start") + 1
    kind = F.when(days.between(*DIRECT_DAYS), "direct").when(days.between(*CUMULATED_DAYS), "cumulated")
    classed = facts.withColumn("_kind", kind).filter(F.col("_kind").isNotNull() & F.col("value").isNotNull())
    entry = F.struct("end", *(c for c in kept if c != "end"), F.lit(False).alias("derived"))
    ties = [F.col("accession")] if "accession" in kept else []
    best = F.max_by("_f", F.struct(*rank(f), -_days(f), *(c.alias("_tie") for c in ties), f["value"]))
    ends = classed.withColumn("_f", entry).groupBy(*keys, "_kind", "end").agg(best.alias("_f"))
    gathered = ends.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.when(F.col("_kind") == k, f))).alias(f"_{k}") for k in ("direct", "cumulated")))

    def step(done, c):
        inside = F.filter(done, lambda e: (e["start"] >= c["start"]) & (e["end"] < c["end"]))
        asked = F.greatest(F.bround(_days(c) / 91) - 1, F.lit(1))
        good = (F.size(inside) == asked) & ~F.exists(done, lambda e: e["end"] == c["end"])
        lower = c["concept_priority"] - 1
        fields = {
            "start": F.date_add(F.array_max(F.transform(inside, lambda e: e["end"])), 1),
            "value": c["value"] - F.aggregate(inside, F.lit(0.0), lambda a, e: a + e["value"]),
            "concept_priority": lower if least is None else F.greatest(lower, F.lit(least)),
            "derived": F.lit(True),
        }
        rest = F.struct(*(fields.get(n, c[n]).alias(n) for n in ("end", *(x for x in kept if x != "end"), "derived")))
        return F.when(good, F.concat(done, F.array(rest))).otherwise(done)

    return gathered.select(*keys, F.explode(F.aggregate("_cumulated", F.col("_direct"), step)).alias("_f"))


def _quarter(day: Column) -> Column:
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("long")


def _value(f: Column) -> Column:
    return F.when(f["derived"], F.round(f["value"], 3) + F.lit(0.0)).otherwise(f["value"])


def quarterise(facts: DataFrame, keys: list[str], by_field: bool = False, first: int = FIRST_QUARTER) -> DataFrame:
    """the best fact of each calendar quarter from `first`, of given quarters and those that cumulated facts yield.

    Facts (start, end, value, concept_priority, namespace_priority, filed, accession) of 45 to 120 days are direct, of 121 to 390
    cumulated. The facts of one concept go by time of filing before priorities; `by_field` those of one field, whose concepts compete,
    by priorities before time. A derived fact has a priority less by one, and at least one. Equal ranks go to direct facts, then to
    the earlier end.
    """
    rank = field_rank if by_field else concept_rank
    f = F.col("_f")
    rows = _derived(facts.select(*keys, "start", "end", F.col("value").cast("double").alias("value"), F.col("concept_priority").cast("int").alias("concept_priority"), "namespace_priority", "filed", "accession"), keys, rank, 1)
    order = F.struct(*rank(f), ~f["derived"], -F.unix_date(f["end"]))
    best = rows.withColumn("q_ord", _quarter(f["end"])).filter(F.col("q_ord") >= first).groupBy(*keys, "q_ord").agg(F.max_by("_f", order).alias("_f"))
    return best.select(*keys, "q_ord", f["start"].alias("start"), f["end"].alias("end"), _value(f).alias("value"), f["derived"].alias("derived"))


def quarterise_segments(facts: DataFrame, keys: list[str], first: int = FIRST_QUARTER) -> DataFrame:
    """F2 for segments: facts (member, label, start, end, value, concept_priority, form, filed) to members by quarter, in billions.

    Members whose labels have one signature are one series under its longest label, the first by name if several; series of generic
    members alone go (B9). In a quarter the best fact stands for a label's key; rows of equal value of which one's name holds the
    other's are one, under the longer name, taken in order of their keys. Values to 0.001 go; of three or more rows those with
    aggregate labels (B7) go if two others stay, and those with combined labels (B8) if any other stays.
    """
    given = F.when(F.col("label") != "", F.col("label"))
    named = F.coalesce(given, member_label(F.col("member")))
    own = F.coalesce(*(F.when(c != "", c) for c in (signature(named), ascii_key(F.regexp_replace(named, r"\bSegment\b", "")), F.trim("member"))))
    rows = facts.withColumn("_series", own).filter(F.col("_series").isNotNull())
    specific = labels.drop_generic(rows.select(*keys, "_series", "member").distinct(), keys).select(*keys, "_series").distinct()
    longest = rows.groupBy(*keys, "_series").agg(F.min_by(given, F.struct(-F.length(given), given)).alias("_label"))
    typed = rows.select(*keys, "_series", "start", "end", F.col("value").cast("double").alias("value"), F.col("concept_priority").cast("int").alias("concept_priority"), "form", "filed")
    f = F.col("_f")
    series = _derived(typed, [*keys, "_series"], segment_rank, None).join(specific, [*keys, "_series"]).join(longest, [*keys, "_series"])
    text = F.coalesce("_label", member_label(F.col("_series")))
    name = F.regexp_replace(F.trim(F.regexp_replace(text, r"\bSegment\b", "")), r"\s+", " ")
    quarters = series.withColumn("q_ord", _quarter(f["end"])).filter(F.col("q_ord") >= first).withColumn("name", name).withColumn("_key", ascii_key("name"))
    one = quarters.groupBy(*keys, "q_ord", "_key").agg(F.max_by(F.struct("_key", "name", F.round(f["value"] / 1e9, 3).alias("value"), f["start"].alias("start"), f["end"].alias("end"), f["derived"].alias("derived")), F.struct(*segment_rank(f), f["start"], "name")).alias("_r"))
    all_rows = one.groupBy(*keys, "q_ord").agg(F.sort_array(F.collect_list("_r")).alias("_all"))

    def merge(done, r):
        same = F.transform(done, lambda m: (F.abs(m["value"] - r["value"]) < 0.001) & (r["name"].contains(m["name"]) | m["name"].contains(r["name"])))
        at = F.array_position(same, F.lit(True)) - 1
        put = F.transform(done, lambda m, i: F.when((i == at) & (F.length(r["name"]) > F.length(m["name"])), r).otherwise(m))
        return F.when(at < 0, F.concat(done, F.array(r))).otherwise(put)

    merged = all_rows.select(*keys, "q_ord", F.explode(F.aggregate("_all", F.slice("_all", 1, 0), merge)).alias("_r")).select(*keys, "q_ord", "_r.*")
    quarter = [*keys, "q_ord"]
    flagged = labels.combined(merged.withColumnRenamed("name", "member"), quarter).drop("has_other", "_key")
    per = Window.partitionBy(*quarter)
    held = flagged.filter(F.col("value") > 0.001).withColumn("_sum", labels.aggregate_like(member_label(F.col("member")))).withColumn("_n", F.count(F.lit(1)).over(per))
    plain = held.withColumn("_plain", F.count_if(~F.col("_sum")).over(per)).filter((F.col("_n") < 3) | (F.col("_plain") < 2) | ~F.col("_sum"))
    left = plain.withColumn("_single", F.count_if(~F.col("is_combined")).over(per)).filter((F.col("_n") < 3) | (F.col("_single") == 0) | ~F.col("is_combined"))
    return left.select(*quarter, "member", "value", "start", "end", "derived")

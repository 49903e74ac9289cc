"""A company's quarters in order, where each step rests on the one before; and layouts of a quarter's rows.

Groups are a company's quarters or a quarter's rows: their size does not grow with the number of companies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _comparable(a: dict, b: dict) -> bool:
    """Two quarters' members (with shares): Jaccard 0.58, or common shares of 0.55 on both sides with at most 0.26 missing or extra."""
    common = a.keys() & b.keys()
    if len(common) < 2:
        return False
    share = lambda m, names: sum(m[n] for n in names)
    near = share(a, common) >= 0.55 and share(b, common) >= 0.55 and share(a, a.keys() - common) <= 0.26 and share(b, b.keys() - common) <= 0.26
    return len(common) / len(a.keys() | b.keys()) >= 0.58 or near


def phases(members: DataFrame) -> DataFrame:
    """the taxonomy phase of each quarter (company, q_ord, member, value, revenue).

    Quarters in order keep the phase while comparable to its anchor, and, with three members or more on both sides, at a Jaccard
    similarity of 0.75 or more. The anchor moves to a quarter that scores as much: 20 a member, 12 times the coverage, a hundredth
    of the revenue. Quarters of fewer than two members have none, unless both neighbours have the same one.
    """
    sets = members.filter(F.col("value") > 0.02).groupBy("company", "q_ord", "revenue").agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("members"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("q_ord")
        out, anchor, best, phase = [], None, 0.0, 0
        for values, revenue in zip(frame["members"], frame["revenue"]):
            values = dict(values)
            if len(values) < 2:
                out.append(None)
                continue
            whole = max(revenue, 0.001)
            shares = {k: v / whole for k, v in values.items()}
            score = len(values) * 20 + 12 * sum(values.values()) / whole + revenue * 0.01
            if anchor is not None and anchor.keys() != shares.keys():
                alike = len(anchor.keys() & shares.keys()) / len(anchor.keys() | shares.keys())
                if not _comparable(anchor, shares) or (len(anchor) >= 3 and len(shares) >= 3 and alike < 0.75):
                    anchor, phase = None, phase + 1
            if anchor is None or score >= best:
                anchor, best = shares, score
            out.append(phase)
        for i in range(1, len(out) - 1):
            if out[i] is None and out[i - 1] is not None and out[i - 1] == out[i + 1]:
                out[i] = out[i - 1]
        return pd.DataFrame({"company": frame["company"], "q_ord": frame["q_ord"], "phase": pd.array(out, dtype="Int64")})

    return sets.groupBy("company").applyInPandas(one, "company long, q_ord long, phase long")


def fill_gaps(members: DataFrame) -> DataFrame:
    """members a quarter lacks against its neighbours (company, q_ord, member, value, revenue), in order of quarters.

    Both neighbouring rows hold the same members, all of the quarter's and one or two more; over 0.12 of the revenue is left, which
    these share by their neighbours' mean shares. Rows of 0.02 or less are not added; a rest of over 0.03 becomes otherrevenue. (Were the
    row before filled itself, it would hold what this one holds, which then lacks nothing: so rows as given decide.)
    """
    rest, order = "otherrevenue", Window.partitionBy("company").orderBy("q_ord")
    quarters = members.groupBy("company", "q_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", "value")))).alias("now"), F.max("revenue").alias("revenue"))
    near = quarters.select("*", F.lag("now").over(order).alias("before"), F.lead("now").over(order).alias("after"))
    named = lambda m: F.array_sort(F.filter(F.map_keys(m), lambda k: k != rest))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    share = lambda m, k: F.try_divide(m[k], total(F.map_values(m)))
    near = near.select("*", named("now").alias("have"), F.array_except(named("before"), named("now")).alias("lacks"), F.coalesce(F.try_element_at("now", F.lit(rest)), F.lit(0.0)).alias("left"))
    fits = (named("before") == named("after")) & (F.size("have") > 0) & (F.size(F.array_except("have", named("before"))) == 0) & F.size("lacks").between(1, 2)
    spare = F.greatest(F.col("revenue") - total(F.transform("have", lambda k: F.col("now")[k])), F.lit(0.0))
    near = near.withColumn("gap", F.when(F.col("left") > 0.02, F.col("left")).otherwise(spare)).withColumn("weights", F.when(F.coalesce(fits, F.lit(False)), F.transform("lacks", lambda k: F.struct(k.alias("member"), ((share(F.col("before"), k) + share(F.col("after"), k)) / 2).alias("w")))))
    weight = total(F.transform("weights", lambda x: x["w"]))
    added = F.filter(F.transform("weights", lambda x: F.struct(x["member"].alias("member"), F.round(F.try_divide(F.col("gap") * x["w"], weight), 3).alias("value"), F.lit(True).alias("filled"))), lambda x: x["value"] > 0.02)
    near = near.withColumn("added", F.when((F.col("gap") > 0.12) & (weight > 0.000001) & (F.size(added) > 0), added))
    row = lambda k, v: F.struct(k.alias("member"), v.alias("value"), F.lit(False).alias("filled"))
    own = F.transform(F.map_entries("now"), lambda e: row(e["key"], e["value"]))
    over = F.round(F.col("gap") - total(F.transform("added", lambda x: x["value"])), 3)
    whole = F.concat(F.filter(own, lambda x: x["member"] != rest), "added", F.when(over > 0.03, F.array(row(F.lit(rest), over))).otherwise(F.array().cast("array<struct<member:string,value:double,filled:boolean>>")))
    return near.select("company", "q_ord", F.explode(F.when(F.col("added").isNotNull(), whole).otherwise(own)).alias("r")).select("company", "q_ord", "r.*")


def best_subset(rows: DataFrame, most: int = 12, aggregate: Column | None = None, targets: Column | None = None, styled: Column | None = None) -> DataFrame:
    """of a quarter's largest `most` rows (member, value, revenue, penalty, tokens) the two to seven that explain the revenue best.

    aggregate marks rows that sum others up or combine them: in quarters of three rows or more they go first, if others are left.
    targets (of the quarter) are the members that its details hang under: if any is there, all have to be in the set. Quarters that
    add up as they are keep all rows: three to six at 0.88 to 1.18 of the revenue, seven at most with all targets at 0.72 to 1.18,
    and quarters styled as published at 0.78 to 1.18.

    Else a set's sum is 0.45 to 1.35 of the revenue. It scores 44 for three to six rows, less 110 a unit off the revenue, 18 a row past
    five, 40 a row short of three (of four or more), 260 and 360 a unit of share below 0.78 and above 1.08, the rows' penalties, and
    28 for each word two of them share. Of scores within 0.01 the smaller set counts, then the first in order of value and name.
    Quarters without such a set keep their seven largest rows. The cut to `most` rows bounds the sets.
    """
    given = lambda c, other: other if c is None else F.coalesce(c, other)
    none = F.array().cast("array<string>")
    rows = rows.select("*", given(aggregate, F.lit(False)).alias("_sums"), given(targets, none).alias("_targets"), given(styled, F.lit(False)).alias("_styled"))
    cells = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "member", "penalty", "tokens", "_sums")))
    groups = rows.filter((F.col("value") > 0.02) & (F.col("revenue") > 0)).groupBy("company", "q_ord", "revenue").agg(F.slice(cells, 1, most).alias("rows"), F.array_distinct(F.max("_targets")).alias("_targets"), F.max("_styled").alias("_styled"))
    single = F.filter("rows", lambda r: ~r["_sums"])
    groups = groups.withColumn("rows", F.when((F.size("rows") >= 3) & (F.size(single) > 0), single).otherwise(F.col("rows")))
    n, met = F.size("rows"), F.size(F.array_intersect("_targets", F.transform("rows", lambda r: r["member"])))
    ratio = F.aggregate("rows", F.lit(0.0), lambda total, r: total - r["v"]) / F.col("revenue")
    held = (met > 0) & (met == F.size("_targets")) & (n <= 7) & ratio.between(0.72, 1.18)
    whole = held | (F.col("_styled") & ratio.between(0.78, 1.18)) | (n.between(3, 6) & ratio.between(0.88, 1.18))
    groups = groups.select("company", "q_ord", "revenue", "rows", whole.alias("whole"), F.when(met > 0, F.col("_targets")).otherwise(none).alias("needed"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for company, q_ord, revenue, items, whole, needed in batch.itertuples(index=False):
                if whole:
                    out += [(company, q_ord, r["member"], -r["v"]) for r in items]
                    continue
                n = len(items)
                values = np.array([-r["v"] for r in items])
                tokens = [set(r["tokens"]) for r in items]
                shared = np.array([[len(a & b) if i < j else 0 for j, b in enumerate(tokens)] for i, a in enumerate(tokens)], dtype=float)
                masks = np.arange(1, 1 << n)
                on = (masks[:, None] >> np.arange(n)) & 1
                count, total = on.sum(1), on @ values
                ratio = total / revenue
                score = np.where((count >= 3) & (count <= 6), 44.0, 0.0) - np.abs(total - revenue) * 110 - on @ np.array([r["penalty"] for r in items])
                score -= np.where(count > 5, (count - 5) * 18, np.where((count < 3) & (n > 3), (3 - count) * 40, 0))
                score -= np.where(ratio < 0.78, (0.78 - ratio) * 260, np.where(ratio > 1.08, (ratio - 1.08) * 360, 0)) + 28 * np.einsum("ki,ij,kj->k", on, shared, on)
                good = (count <= 7) & ((count > 1) | (n == 1)) & (ratio >= 0.45) & (ratio <= 1.35)
                for name in needed:  # without a row of that name no set is good
                    good &= on @ np.array([r["member"] == name for r in items]) > 0
                best = None
                for i in np.flatnonzero(good):
                    if best is None or score[i] > score[best] or (abs(score[i] - score[best]) < 0.01 and count[i] < count[best]):
                        best = i
                kept = [r for r, take in zip(items, on[best]) if take] if best is not None else list(items[:7])
                out += [(company, q_ord, r["member"], -r["v"]) for r in kept]
            yield pd.DataFrame(out, columns=["company", "q_ord", "member", "value"])

    return groups.mapInPandas(choose, "company long, q_ord long, member string, value double")


def fit_band(rows: DataFrame, top: float, bottom: float, gap: float, least: float) -> DataFrame:
    """L2: rows (company, q_ord, member, height) fitted into a band in order of name, none lower than `least` where there is room.

    Heights are proportional, but for the lowest, which get the minimum: filled up like water, from the lowest on, as long as the next
    one's share of what is left is below it. The gap shrinks where rows are many. Rows without any height share the band evenly. What is
    left over goes to the last row, no row is lower than 1, and the last row ends at the band's end.
    """
    band = max(bottom - top, 1.0)
    per = Window.partitionBy("company", "q_ord")
    low, name = per.orderBy("raw", "member"), per.orderBy("member")
    sized = rows.select("company", "q_ord", "member", F.greatest(F.coalesce(F.col("height").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("raw"))
    sized = sized.withColumn("n", F.count(F.lit(1)).over(per)).withColumn("whole", F.sum("raw").over(per))
    space = F.when(F.col("n") > 1, F.least(F.lit(float(gap)), F.greatest((F.lit(band) - 1) / (F.col("n") - 1), F.lit(0.0)))).otherwise(0.0)
    sized = sized.withColumn("space", space).withColumn("room", F.greatest(F.lit(band) - F.col("space") * (F.col("n") - 1), F.lit(1.0)))
    sized = sized.withColumn("floor", F.least(F.lit(float(least)), F.col("room") / F.col("n")))
    # if the k lowest get the minimum, the others share what is left in proportion
    k = F.row_number().over(low) - 1
    rate = F.try_divide(F.greatest(F.col("room") - F.col("floor") * k, F.lit(0.0)), F.col("whole") - F.coalesce(F.sum("raw").over(low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    filled = sized.withColumn("k", k).withColumn("rate", rate)
    enough = F.min_by(F.struct("k", "rate"), F.when((F.col("raw") > 0) & (F.col("raw") * F.col("rate") >= F.col("floor")), F.col("k"))).over(per)
    filled = filled.withColumn("free", enough)
    height = F.when(F.col("whole") <= 0, F.col("room") / F.col("n")).when(F.col("free").isNotNull() & (F.col("k") >= F.col("free.k")), F.col("raw") * F.col("free.rate")).otherwise(F.col("floor"))
    filled = filled.withColumn("h", height).withColumn("is_last", F.row_number().over(name) == F.col("n"))
    off = F.col("room") - F.sum("h").over(per)
    filled = filled.withColumn("h", F.greatest(F.when(F.col("is_last") & (F.abs(off) > 0.01) & (F.col("whole") > 0), F.col("h") + off).otherwise(F.col("h")), F.when(F.col("whole") > 0, 1.0).otherwise(0.0)))
    start = F.lit(float(top)) + F.coalesce(F.sum(F.col("h") + F.col("space")).over(name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ends = filled.withColumn("start", start)
    return ends.select("company", "q_ord", "member", F.round("start", 6).alias("top"), F.round(F.when(F.col("is_last"), float(bottom)).otherwise(F.col("start") + F.col("h")), 6).alias("bottom"))


def place_boxes(rows: DataFrame, low: float, high: float, gap: float) -> DataFrame:
    """L4: boxes (company, q_ord, member, center, height) moved as little as it takes not to overlap: down from the first, then up from
    the last where that leaves the range, and all down again where the first does. Equal tops keep the order of names.

    With the boxes packed from 0 on, a box lies as far below its packed place as the farthest of those up to it asks (a running
    maximum), and at most as far as the boxes behind it allow (a running minimum from the end).
    """
    per = Window.partitionBy("company", "q_ord")
    tall = F.greatest(F.col("height").cast("double"), F.lit(1.0))
    wish = F.greatest(F.least(F.col("center") - tall / 2, F.lit(float(high)) - tall), F.lit(float(low)))
    boxes = rows.select("company", "q_ord", "member", tall.alias("tall"), wish.alias("wish"))
    order = per.orderBy("wish", "member")
    packed = F.coalesce(F.sum(F.col("tall") + F.lit(float(gap))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    boxes = boxes.withColumn("packed", packed).withColumn("is_last", F.lead("member").over(order).isNull())
    boxes = boxes.withColumn("shift", F.max(F.col("wish") - F.col("packed")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    beyond = F.max(F.when(F.col("is_last"), F.col("packed") + F.col("shift") + F.col("tall"))).over(per) > high
    allowed = F.when(F.col("is_last"), F.lit(float(high)) - F.col("tall") - F.col("packed")).otherwise(F.col("shift"))
    back = F.min(allowed).over(order.rowsBetween(0, Window.unboundedFollowing))
    boxes = boxes.withColumn("at", F.col("packed") + F.when(beyond, back).otherwise(F.col("shift")))
    boxes = boxes.withColumn("at", F.col("at") + F.greatest(F.lit(float(low)) - F.min("at").over(per), F.lit(0.0)))
    return boxes.select("company", "q_ord", "member", F.round("at", 6).alias("top"), F.round(F.col("at") + F.col("tall"), 6).alias("bottom"))


def conserved_bands(rows: DataFrame, least: float = 1.0) -> DataFrame:
    """L3: a flow's band is as high as the lower of its source and target, at least `least`, around the target's centre."""
    height = F.greatest(F.least("source_height", "target_height"), F.lit(least))
    return rows.select("company", "q_ord", "member", (F.col("target_center") - height / 2).alias("top"), (F.col("target_center") + height / 2).alias("bottom"))


def grid_lines(observations: DataFrame, row_gap: float = 0.009, column_gap: float = 0.065) -> DataFrame:
    """H8: lines of cells joined by " | " from observations on a page (page, text, x, y, height), upper lines first (y points up).

    Observations in order of y form a row while within the gap (or 0.45 of their height) of the row's running mean. Columns gather x
    in order of rows, each within the gap of a column's moving place; a text goes to the nearest column. Pages with fewer than two
    columns give no lines; blank texts don't count.
    """
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    item = F.struct(number("y").alias("y"), number("x").alias("x"), number("height").alias("height"), clean.alias("text"))
    pages = observations.filter(clean != "").groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    # rows: the state is the row's number, its mean and size, and the numbers of the items so far
    state = lambda row, mean, n, rows: F.struct(row.alias("row"), mean.alias("mean"), n.alias("n"), rows.alias("rows"))

    def place(a: Column, x: Column) -> Column:
        near = (a["n"] > 0) & (F.abs(x["y"] - a["mean"]) <= F.greatest(F.lit(row_gap), x["height"] * 0.45))
        n = a["n"] + 1
        same = state(a["row"], a["mean"] + (x["y"] - a["mean"]) / n, n, F.concat(a["rows"], F.array(a["row"])))
        return F.when(near, same).otherwise(state(a["row"] + 1, x["y"], F.lit(1), F.concat(a["rows"], F.array(a["row"] + 1))))

    start = state(F.lit(0), F.lit(0.0), F.lit(0), F.array().cast("array<int>"))
    placed = pages.withColumn("rows", F.aggregate("items", start, place, lambda a: a["rows"]))
    # zipped, as a fold that a lambda names is made again for each of its items
    cells = F.array_sort(F.transform(F.arrays_zip("items", "rows"), lambda z, i: F.struct(z["rows"].alias("row"), z["items"]["x"].alias("x"), i.alias("i"), z["items"]["y"].alias("y"), z["items"]["text"].alias("text"))))

    def gather(places: Column, c: Column) -> Column:
        near = lambda p: F.abs(c["x"] - p) <= column_gap
        at = F.array_position(F.transform(places, near), True)  # made once: the lambda below is of an array of its own
        moved = lambda j: F.transform(places, lambda p, k: F.when(k + 1 == j, (p + c["x"]) / 2).otherwise(p))
        placed = F.transform(F.array(at), lambda j: F.when(j == 0, F.array_sort(F.concat(places, F.array(c["x"])))).otherwise(moved(j)))
        return F.get(placed, F.lit(0))

    columns = placed.withColumn("cells", cells).withColumn("places", F.array_sort(F.aggregate("cells", F.array().cast("array<double>"), gather)))
    each = columns.select("page", "places", F.explode(F.when(F.size("places") > 1, F.col("cells"))).alias("c"))  # a filter would make the folds twice
    nearest = F.array_min(F.transform("places", lambda p, k: F.struct(F.abs(p - F.col("c.x")).alias("off"), k.alias("k"))))["k"]
    joined = lambda parts, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col(parts).alias("t")))), lambda x: x["t"]), " " if parts == "text" else " | ")
    texts = each.select("page", nearest.alias("column"), "c.*").groupBy("page", "row", "column").agg(joined("text", ["x", "i"]).alias("cell"), F.min("y").alias("y"))
    lines = texts.groupBy("page", "row").agg(joined("cell", ["column"]).alias("text"), F.min("y").alias("y"))
    return lines.select("page", (F.row_number().over(Window.partitionBy("page").orderBy(F.desc("y"), "row")) - 1).cast("long").alias("line"), "text")

"""A company's revenue by segment over its quarters, repaired step by step.

A quarter is a row: its members as given (`raw`) and as shown (`rows`), arrays of structs that are sorted by value, largest
first, then by name.  Steps that look at one quarter are column expressions; steps that look at the quarters next to it are
windows over the company, where of quarters in a row that could be repaired every other one is (`_alternate`), as a repaired
one agrees with the next; phases, whose anchor moves, and two steps whose values go on from quarter to quarter are folds over
a company's quarters (`in_order`); templates are minima over an array of candidates.  All is partitioned by company; a company
has four quarters a year, so its arrays don't grow with the number of companies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.labels import aggregate_like
from tallyloom.sources.lineage import cut

REST, WHOLE, OTHERS = "otherrevenue", "reportedrevenue", "__other_segments__"
ROWS = "array<struct<member:string,value:double>>"
#: Labels of concepts, not of segments.
CONCEPTS = ("sales and other operating revenue", "income from equity affiliates", "other revenue interest", "fees and commissions", "service charges", "noninterest income", "interest income expense net")
STATE = ["revenue", "style", "source", "score", "raw", "rows", "coverage", "partial", "whole_only", "given", "schema", "family", "phase", "filled", "imputed", "smoothed", "notes"]


def _company() -> Window:
    return Window.partitionBy("company")


def _order() -> Window:
    return _company().orderBy("q_ord")


# ---------------------------------------------------------------- rows of a quarter


def rounded(x: Column) -> Column:
    """To thousandths, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def row(member: Column, value: Column) -> Column:
    return F.struct(member.alias("member"), value.alias("value"))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is made once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_rows() -> Column:
    return F.array().cast(ROWS)


def total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["value"])


def most(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: F.greatest(a, x))


def amount(rows: Column, member: Column) -> Column:
    return F.coalesce(F.get(F.filter(rows, lambda x: x["member"] == member), F.lit(0))["value"], F.lit(0.0))


def held(rows: Column, members: Column) -> Column:
    return total(F.filter(rows, lambda x: F.array_contains(members, x["member"])))


def share(rows: Column, member: Column) -> Column:
    """A member's share of the rows; none where these sum to 0.02 or less."""
    return F.when(total(rows) > 0.02, amount(rows, member) / total(rows)).otherwise(0.0)


def shares(rows: Column) -> Column:
    return once(total(rows), lambda t: F.transform(rows, lambda x: row(x["member"], F.when(t > 0.02, amount(rows, x["member"]) / t).otherwise(0.0))))


def largest_first(rows: Column) -> Column:
    ordered = F.array_sort(F.transform(rows, lambda x: F.struct((-x["value"]).alias("less"), x["member"].alias("member"))))
    return F.transform(ordered, lambda x: row(x["member"], -x["less"]))


def shown(rows: Column) -> Column:
    """Rows of over 0.02, largest first."""
    return largest_first(F.filter(rows, lambda x: x["value"] > 0.02))


def names(rows: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["member"])))


def stable_names(rows: Column) -> Column:
    """Members but for what is left over."""
    return F.filter(names(rows), lambda m: (m != REST) & (m != WHOLE))


def optional(member: Column) -> Column:
    return member.isin(REST, WHOLE) | aggregate_like(member)


def comparable_rows(rows: Column) -> Column:
    """Rows of over 0.02 that are segments; if fewer than two are, all but the reported whole."""
    return once(_substantive(rows), lambda own: F.when(F.size(own) >= 2, own).otherwise(F.filter(rows, lambda x: (x["member"] != WHOLE) & (x["value"] > 0.02))))


def _substantive(raw: Column) -> Column:
    return F.filter(raw, lambda x: (x["value"] > 0.02) & ~optional(x["member"]))


def conceptual() -> Column:
    """Two or more segments, all of them concepts."""
    told = lambda x: F.lower(x["member"]).rlike("|".join(CONCEPTS))
    return (F.size(_substantive(F.col("raw"))) >= 2) & F.forall(_substantive(F.col("raw")), told)


def coarse() -> Column:
    """No more than one segment, or none but concepts."""
    return (F.size("raw") == 0) | F.col("whole_only") | (F.size(_substantive(F.col("raw"))) <= 1) | conceptual()


def noted(note: Column | str) -> Column:
    return F.array_union("notes", F.array(F.lit(note)))


def first_takes(values: Column, left: Column) -> Column:
    """Values with what is left, if over 0.004, added to the first."""
    return F.transform(values, lambda x, i: row(x["member"], F.when((i == 0) & (F.abs(left) > 0.004), rounded(x["value"] + left)).otherwise(x["value"])))


def with_made(df: DataFrame, weights: Column, where: Column) -> DataFrame:
    """df with `made`: rows of the revenue by weights (member, value), where that holds; positive ones count, what is left goes to the first."""
    df = df.withColumn("_used", F.filter(F.when(where, weights), lambda x: x["value"] > 0)).withColumn("_whole", total(F.col("_used")))
    df = df.withColumn("_values", F.when((F.col("revenue") > 0.02) & (F.col("_whole") > 0.000001), F.transform("_used", lambda x: row(x["member"], rounded(F.col("revenue") * (x["value"] / F.col("_whole")))))))
    return df.withColumn("made", largest_first(first_takes(F.col("_values"), rounded(F.col("revenue") - total(F.col("_values")))))).drop("_used", "_whole", "_values")


def with_fit(df: DataFrame, rows: str, least: Column) -> DataFrame:
    """df with fit_rows, fit_coverage, fit_partial and fit_note of rows against the revenue.

    Below `least` of it there are none, above 1.12 rows are scaled, below 0.94 a rest is added.
    """
    revenue, whole, own = F.col("revenue"), F.col("_whole"), F.col(rows)
    df = df.withColumn("_whole", total(own)).withColumn("_left", revenue - whole)
    note = F.when(~((revenue > 0.02) & (F.size(own) > 0)), "none").when(whole / revenue < least, "coverage-too-low").when(whole / revenue > 1.12, "scaled-down").when((whole / revenue < 0.94) & (F.col("_left") > 0.03), "residual-added").otherwise("none")
    df = df.withColumn("fit_note", note)
    scaled = F.transform(own, lambda x: row(x["member"], rounded(x["value"] * (revenue / whole))))
    joined = F.transform(own, lambda x: row(x["member"], F.when(x["member"] == REST, rounded(x["value"] + F.col("_left"))).otherwise(x["value"])))
    added = F.when(F.exists(own, lambda x: x["member"] == REST), joined).otherwise(F.concat(own, F.array(row(F.lit(REST), rounded(F.col("_left"))))))
    out = F.when(F.col("fit_note") == "coverage-too-low", no_rows()).when(F.col("fit_note") == "scaled-down", scaled).when(F.col("fit_note") == "residual-added", added).otherwise(own)
    fit = {"fit_rows": largest_first(out), "fit_coverage": F.when(revenue > 0.02, whole / revenue), "fit_partial": F.col("fit_note") == "coverage-too-low"}
    return df.withColumns(fit).drop("_whole", "_left")


def _least() -> Column:
    return F.when(F.col("style").isNotNull(), 0.36).otherwise(0.62)


def _set(df: DataFrame, when: Column, **new: Column) -> DataFrame:
    """df with new values of columns, where `when` holds."""
    told = df.withColumn("_when", F.coalesce(when, F.lit(False)))
    return told.withColumns({c: F.when(F.col("_when"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_when")


# ---------------------------------------------------------------- quarters


def quarter_rows(sources: DataFrame) -> DataFrame:
    """company, q_ord and STATE from company, q_ord, revenue, style, source, score, scale and segments (ROWS) of one source each.

    Values are multiplied by the scale of the display currency; a quarter without revenue has its segments' sum; quarters that
    have neither are left out. Revenue and rows are then reconciled.
    """
    scaled = F.filter(F.transform("segments", lambda x: row(x["member"], rounded(x["value"] * F.col("scale")))), lambda x: x["member"].isNotNull() & x["value"].isNotNull())
    given = sources.withColumn("raw", largest_first(F.coalesce(scaled, no_rows())))
    given = given.withColumn("revenue", rounded(F.when(F.col("revenue") > 0.02, F.col("revenue") * F.col("scale")).otherwise(total(F.col("raw"))))).filter((F.col("revenue") > 0.02) | (F.size("raw") > 0))
    given = with_fit(given.withColumn("keys", names(F.col("raw"))), "raw", _least())
    family = F.when(F.size("keys") >= 2, F.concat(F.lit("legacy:"), F.array_join(F.slice("keys", 1, 3), "|"))).when(F.size("keys") == 1, F.concat(F.lit("single:"), F.get("keys", F.lit(0)))).otherwise("unknown")
    schema = F.when(F.col("style").isNotNull(), F.concat(F.lit("style:"), "style")).when(F.size("keys") > 0, F.concat(F.lit("keys:"), F.array_join("keys", "|"))).otherwise("schema:unknown")
    whole_only, none = (F.size("raw") == 1) & (F.coalesce(F.get("raw", F.lit(0))["member"], F.lit("")) == WHOLE), F.lit(None).cast("int")
    state = {
        "revenue": "revenue", "style": "style", "source": "source", "score": F.col("score").cast("double"), "raw": "raw", "rows": "fit_rows", "coverage": "fit_coverage", "partial": "fit_partial", "whole_only": whole_only, "given": F.size("raw") > 0,
        "schema": schema, "family": F.coalesce("style", family), "phase": none, "filled": F.lit(False), "imputed": F.lit(False), "smoothed": F.lit(False), "notes": F.array_except(F.array("fit_note"), F.array(F.lit("none"))),
    }
    return given.select("company", "q_ord", *((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in state.items()))


def beside(quarters: DataFrame, *columns: str) -> DataFrame:
    """quarters with before_<c> and after_<c> of each column: those of the quarters next to it."""
    return quarters.withColumns({f"{side}_{c}": f(c).over(_order()) for c in columns for side, f in (("before", F.lag), ("after", F.lead))})


def _alternate(quarters: DataFrame, fits: Column) -> DataFrame:
    """quarters with `turn`: the first, third, ... of quarters in a row that fit."""
    told = quarters.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_at", F.row_number().over(_order()))
    since = F.col("_at") - F.coalesce(F.max(F.when(~F.col("_fits"), F.col("_at"))).over(_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return told.withColumn("turn", F.col("_fits") & (since % 2 == 1)).drop("_fits", "_at")


def _state(quarters: DataFrame) -> DataFrame:
    return quarters.select("company", "q_ord", *STATE)


def in_order(quarters: DataFrame, rows: Callable[[Column, Column], Column]) -> DataFrame:
    """quarters whose rows become rows(those of the quarter before, as they are by then; the quarter), company by company in order."""
    others = [c for c in quarters.columns if c not in ("company", "q_ord", "rows")]
    packed = quarters.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("q_ord", "rows", *others))).alias("quarters"))
    step = lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x["rows"]).otherwise(rows(F.element_at(done, -1), x))))
    folded = packed.withColumn("new", F.aggregate("quarters", F.array().cast(f"array<{ROWS}>"), step))
    return folded.select("company", F.posexplode("quarters").alias("i", "x"), "new").select("company", "x.q_ord", F.get("new", F.col("i")).alias("rows"), *(F.col(f"x.{c}").alias(c) for c in others))


# ---------------------------------------------------------------- F18, F19: taxonomies against an anchor


def _sided(quarter: Column) -> Column:
    """A quarter (q_ord, raw, revenue, style) with its segments, as they are compared, and their names."""
    return once(comparable_rows(quarter["raw"]), lambda own: F.struct(*(quarter[c].alias(c) for c in ("q_ord", "raw", "revenue", "style")), own.alias("segments"), names(own).alias("names")))


def _compared(own: Column, anchor: Column) -> Column:
    """Why or why not `own` is comparable with `anchor` (both _sided), and its rows, segments and the members it has alone, bundled."""
    whole = lambda x: F.greatest(x["revenue"], F.lit(0.001))
    one_style = own["style"] == anchor["style"]

    def bundled(d: Column) -> Column:
        want, got = d["want"], d["sum"] / whole(own)
        close = ((want > 0.1) & (got > 0.1) & (got / F.greatest(want, F.lit(0.001))).between(0.55, 1.8)) | (F.abs(want - got) <= 0.18)
        bundle = (F.size(d["miss"]) == 1) & F.size(d["extra"]).between(1, 3) & (F.size(F.array_intersect(anchor["names"], own["names"])) >= 2) & close
        joined = F.concat(F.filter(own["raw"], lambda x: ~F.array_contains(d["extra"], x["member"])), F.array(row(F.get(d["miss"], F.lit(0)), rounded(d["sum"]))))
        shape = lambda told, rows, segments, of: F.struct(F.lit(told).alias("bundle"), rows.alias("rows"), segments.alias("segments"), of.alias("names"))
        as_bundle = once(joined, lambda rows: once(comparable_rows(rows), lambda o: shape(True, rows, o, names(o))))
        return F.when(bundle, as_bundle).otherwise(shape(False, own["raw"], own["segments"], own["names"]))

    def judged(o: Column, d: Column) -> Column:
        inside = lambda rows, members, of: held(rows, d[members]) / whole(of)
        alike = F.size(d["both"]) / F.greatest(F.size(F.array_union(anchor["names"], o["names"])), F.lit(1))
        near = (inside(anchor["segments"], "both", anchor) >= 0.55) & (inside(o["segments"], "both", own) >= 0.55) & (inside(anchor["segments"], "miss", anchor) <= 0.26) & (inside(o["segments"], "extra", own) <= 0.26)
        like = (F.size(d["both"]) >= 2) & ((alike >= 0.58) | near | (F.coalesce(one_style, F.lit(False)) & (inside(anchor["segments"], "both", anchor) >= 0.45)))
        reason = (
            F.when(own["q_ord"] == anchor["q_ord"], "anchor-quarter").when(~F.coalesce(one_style, F.lit(True)), "style-mismatch").when((F.size(anchor["segments"]) < 2) | (F.size(own["segments"]) < 1), "insufficient-profile")
            .when(~like, "schema-mismatch").when(o["bundle"], "schema-bundled").otherwise("schema-compatible")
        )
        return F.struct(reason.alias("reason"), o["rows"].alias("rows"), o["segments"].alias("segments"), d["extra"].alias("extra"))

    apart = lambda of: F.struct(F.array_except(anchor["names"], of).alias("miss"), F.array_except(of, anchor["names"]).alias("extra"), F.array_intersect(anchor["names"], of).alias("both"))
    alone = once(apart(own["names"]), lambda d: F.struct(d["miss"].alias("miss"), d["extra"].alias("extra"), held(own["raw"], d["extra"]).alias("sum"), (held(anchor["segments"], d["miss"]) / whole(anchor)).alias("want")))
    return once(once(alone, bundled), lambda o: once(apart(o["names"]), lambda d: judged(o, d)))


def _comparable(reason: Column) -> Column:
    return reason.isin("anchor-quarter", "schema-bundled", "schema-compatible")


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs of `own` and `anchor` (structs with q_ord, raw, revenue and style) with `comparable`, `aligned` (rows) and `reason`.

    One member that the anchor has alone, against one to three that the quarter has alone, two or more being common, is a
    bundle if the shares agree: both above a tenth and within 0.55 to 1.8 of each other, or not more than 0.18 apart. The
    bundle takes the anchor's name. Quarters are then comparable if two members or more are common and the Jaccard similarity
    is 0.58, or common members hold 0.55 on both sides and others 0.26 at most; of one style, 0.45 of the anchor is enough.
    What the quarter has alone goes, if it is optional or 0.08 of the revenue at most.
    """
    p = pairs.withColumns({"_o": _sided(F.col("own")), "_a": _sided(F.col("anchor"))}).withColumn("_p", _compared(F.col("_o"), F.col("_a")))
    whole, rows = F.greatest("own.revenue", F.lit(0.001)), F.col("_p.segments")
    drop = F.filter("_p.extra", lambda m: optional(m) | (amount(rows, m) / whole <= 0.08))
    p = p.withColumns({"reason": F.col("_p.reason"), "_drop": drop, "comparable": _comparable(F.col("_p.reason"))})
    kept = shown(F.filter("_p.rows", lambda x: ~F.array_contains(F.col("_drop"), x["member"])))
    p = p.withColumn("aligned", F.when(F.col("reason") == "anchor-quarter", F.col("own.raw")).when(F.col("comparable"), kept).otherwise(no_rows()))
    return p.select(*pairs.columns, "comparable", "aligned", "reason")


def _slim() -> Column:
    return F.struct("q_ord", "raw", "revenue", "style")


def phases(quarters: DataFrame) -> DataFrame:
    """company, q_ord, phase (from 0) and anchor (a q_ord) of the quarters that are in a phase by themselves.

    Reliable quarters (segments given, in full, two or more) come in order. One starts a phase unless its segments are the
    anchor's: if either is the other's bundle and both have three or more; if neither is comparable with the other; or if both
    have three or more and a Jaccard similarity below 0.75. The anchor moves to a quarter that scores as much: 20 a segment, its
    source's score, 12 times its coverage, a hundredth of its revenue. anchor: where the phase's anchor is in the end.
    """
    sided = quarters.filter((F.col("revenue") > 0.02) & ~F.col("whole_only") & ~F.col("partial")).select("company", _sided(_slim()).alias("quarter"), F.col("score").alias("own_score"), "coverage")
    score = F.size("quarter.names") * 20 + F.col("own_score") + F.coalesce("coverage", F.lit(0.0)) * 12 + F.col("quarter.revenue") * 0.01
    one = F.when(F.size("quarter.names") >= 2, F.struct("quarter.q_ord", score.alias("score"), "quarter"))
    listed = sided.groupBy("company").agg(F.array_sort(F.collect_list(one)).alias("quarters"))

    def parts(x: Column, y: Column) -> Column:
        """Whether the two belong to different phases; only those that their names leave open are compared."""
        unlike = F.size(F.array_intersect(x["names"], y["names"])) / F.size(F.array_union(x["names"], y["names"])) < 0.75
        many = (F.size(x["names"]) >= 3) & (F.size(y["names"]) >= 3)
        both = F.struct(_compared(x, y)["reason"].alias("a"), _compared(y, x)["reason"].alias("b"))
        compared = once(both, lambda r: (many & ((r["a"] == "schema-bundled") | (r["b"] == "schema-bundled"))) | ~(_comparable(r["a"]) | _comparable(r["b"])))
        return F.when(x["names"] == y["names"], False).when(many & unlike, True).otherwise(compared)

    # each is compared with the anchor of its time alone, so a company's work grows with its quarters, not with their pairs
    def state(x: Column, phase: Column, anchor: Column, best: Column, done: Column) -> Column:
        told = F.struct(x["q_ord"].alias("q_ord"), phase.alias("phase"), anchor["q_ord"].alias("anchor"))
        return F.struct(phase.alias("phase"), anchor.alias("anchor"), best.alias("best"), F.concat(done, F.array(told)).alias("done"))

    def step(a: Column, x: Column) -> Column:
        moves = lambda new: F.when(new | (x["score"] >= a["best"]), state(x, a["phase"] + new.cast("int"), x["quarter"], x["score"], a["done"])).otherwise(state(x, a["phase"], a["anchor"], a["best"], a["done"]))
        return once(parts(x["quarter"], a["anchor"]), moves)

    first, none = F.get("quarters", F.lit(0)), F.array().cast("array<struct<q_ord:bigint,phase:int,anchor:bigint>>")
    folded = F.aggregate(F.slice("quarters", 2, F.greatest(F.size("quarters") - 1, F.lit(0))), state(first, F.lit(0), first["quarter"], first["score"], none), step, lambda a: a["done"])
    walked = listed.select("company", F.inline(F.when(F.size("quarters") > 0, folded)))
    end = F.last("anchor").over(Window.partitionBy("company", "phase").orderBy("q_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return walked.select("company", "q_ord", "phase", end.alias("anchor"))


def with_phases(quarters: DataFrame) -> DataFrame:
    """quarters with their phases; the rows of those comparable with their phase's anchor are aligned to it and reconciled again.

    A quarter without a phase between two of one phase has theirs.
    """
    found = quarters.drop("phase").join(phases(quarters), ["company", "q_ord"], "left")
    anchors = quarters.select("company", F.col("q_ord").alias("anchor"), _slim().alias("of"))
    pair = found.join(anchors, ["company", "anchor"], "left").withColumns({"own": _slim(), "anchor": F.col("of")}).drop("of")
    told = with_fit(aligned(pair), "aligned", _least())
    notes = F.when(F.col("reason") == "anchor-quarter", F.array_except(F.array("fit_note"), F.array(F.lit("none")))).otherwise(noted(F.col("reason")))
    fits = F.col("anchor").isNotNull() & F.col("comparable") & (F.size("raw") > 0)
    out = _set(told, fits, raw=F.col("aligned"), rows=F.col("fit_rows"), coverage=F.col("fit_coverage"), partial=F.col("fit_partial"), notes=notes)
    between = F.when(F.lag("phase").over(_order()) == F.lead("phase").over(_order()), F.lag("phase").over(_order()))
    return _state(out.withColumn("phase", F.coalesce("phase", between)))


# ---------------------------------------------------------------- F20, F25: quarters between two that agree


def blended(members: Column) -> Column:
    """Each member's mean share in the rows before and after."""
    return F.transform(members, lambda m: row(m, (share(F.col("before_rows"), m) + share(F.col("after_rows"), m)) / 2))


def _with_missing(df: DataFrame) -> DataFrame:
    """df (rows, before_rows, after_rows, missing) with `completed`: rows with the missing members, which share what is left over; null where they can't."""
    spare = F.greatest(F.col("revenue") - total(F.filter("rows", lambda x: ~x["member"].isin(REST, WHOLE))), F.lit(0.0))
    df = df.withColumns({"_rest": amount(F.col("rows"), F.lit(REST)), "_weights": blended(F.col("missing"))}).withColumns({"_gap": F.when(F.col("_rest") > 0.02, F.col("_rest")).otherwise(spare), "_whole": total(F.col("_weights"))})
    df = df.withColumn("_more", F.filter(F.transform("_weights", lambda x: row(x["member"], rounded(F.try_divide(F.col("_gap") * x["value"], F.col("_whole"))))), lambda x: x["value"] > 0.02)).withColumn("_sum", total(F.col("_more")))
    left = rounded(F.col("_gap") - F.col("_sum"))
    whole = F.concat(F.filter("rows", lambda x: x["member"] != REST), "_more", F.when(left > 0.03, F.array(row(F.lit(REST), left))).otherwise(no_rows()))
    return df.withColumn("completed", F.when((F.col("_gap") > 0.12) & (F.col("_whole") > 0.000001) & (F.col("_sum") > 0.02), shown(whole))).drop("_rest", "_weights", "_gap", "_whole", "_more", "_sum")


def _named(quarters: DataFrame, names_of: Callable[[Column], Column], *more: str) -> DataFrame:
    """quarters beside their neighbours, with `have`, `had` and `will`: the members of the quarter and of those before and after."""
    return beside(quarters, "rows", *more).withColumns({"have": names_of(F.col("rows")), "had": names_of(F.col("before_rows")), "will": names_of(F.col("after_rows"))})


def _styled() -> Column:
    return F.col("style").isNotNull() & F.col("before_style").isNotNull() & F.col("after_style").isNotNull() & (F.col("revenue") > 0.02)


def stable_gaps(quarters: DataFrame) -> DataFrame:
    """of one style, one or two members missing against neighbours of equal members, which the quarter's are among."""
    df = _named(quarters, stable_names, "style").withColumn("missing", F.array_except("had", "have"))
    fits = _styled() & (F.size("have") > 0) & (F.col("had") == F.col("will")) & (F.size(F.array_except("have", "had")) == 0) & F.size("missing").between(1, 2)
    told = _alternate(_with_missing(df), fits & F.col("completed").isNotNull())
    return _state(_set(told, F.col("turn"), rows=F.col("completed"), filled=F.lit(True), notes=noted("stable-key-gap-filled")))


def neighbour_schemas(quarters: DataFrame) -> DataFrame:
    """Of one style, a quarter without segments of its own, or with others than both neighbours have, takes their mean shares."""
    df = _named(quarters, names, "style", "schema", "family")
    top = F.aggregate("rows", F.lit(0.0), lambda a, x: F.greatest(a, share(F.col("rows"), x["member"])))
    sound = (F.size("rows") >= 2) & (top < 0.82) & F.coalesce("coverage", F.lit(1.0)).between(0.7, 1.28)
    lacks = (F.size("rows") < 2) | F.col("whole_only") | F.col("partial") | F.array_contains("notes", "coverage-too-low")
    fits = _styled() & (F.size("before_rows") >= 2) & (F.size("after_rows") >= 2) & (F.col("had") == F.col("will")) & F.when(F.col("had") != F.col("have"), ~sound).otherwise(lacks)
    made = _alternate(with_made(df, blended(F.col("had")), fits), F.size("made") > 0)
    return _state(_set(made, F.col("turn"), rows=F.col("made"), filled=F.lit(True), smoothed=F.lit(True), schema=F.col("before_schema"), family=F.col("before_family"), notes=noted("neighbor-schema-harmonized")))


def absorbed_rests(quarters: DataFrame) -> DataFrame:
    """A rest of a hundredth to a tenth goes to the segments by their mean shares next to it, if all three quarters have the same.

    The shares before are those that are left there by then.
    """
    df = _named(quarters, stable_names)
    rest = amount(F.col("rows"), F.lit(REST))
    sound = F.col("source").isin("official-segments", "structure-history") & (F.coalesce("coverage", F.lit(0.0)) >= 0.85) & (F.size(F.filter("raw", lambda x: x["member"] != WHOLE)) >= 2)
    part = rest / F.greatest(F.col("revenue"), F.lit(0.001))
    fits = (F.col("revenue") > 0.02) & (F.col("source") != "official-groups") & ~sound & (F.size("have") > 0) & (F.col("had") == F.col("have")) & (F.col("have") == F.col("will")) & (part > 0.01) & (part <= 0.1)
    df = df.withColumns({"turn": F.coalesce(fits, F.lit(False)), "after_shares": shares(F.col("after_rows")), "rest": rest})
    weight = lambda before, x, m: (share(before, m) + amount(x["after_shares"], m)) / 2

    def rows(before: Column, x: Column) -> Column:
        own = F.filter(x["rows"], lambda r: r["member"] != REST)
        whole = F.aggregate(own, F.lit(0.0), lambda a, r: a + weight(before, x, r["member"]))
        spread = F.transform(own, lambda r: row(r["member"], rounded(r["value"] + F.coalesce(F.try_divide(x["rest"] * weight(before, x, r["member"]), whole), F.lit(0.0)))))
        return F.when(x["turn"], shown(spread)).otherwise(x["rows"])

    told = in_order(df.select("company", "q_ord", *STATE, "turn", "after_shares", "rest"), rows)
    return _state(_set(told, F.col("turn"), smoothed=F.lit(True), notes=noted("residual-absorbed")))


def _next_to() -> Column:
    """All three quarters have revenue, and the neighbours two members or more, the same ones, which the quarter hasn't."""
    alike = (F.size("had") > 0) & (F.col("had") == F.col("will")) & (F.col("had") != F.col("have"))
    return (F.least("revenue", "before_revenue", "after_revenue") > 0.02) & (F.size("before_rows") >= 2) & (F.size("after_rows") >= 2) & alike


def sandwich_segments(quarters: DataFrame) -> DataFrame:
    """reported segments that differ from those that both neighbours agree on.

    Missing ones alone share what is left over; else the quarter takes the neighbours' mean shares. Coverage is 0.72 to 1.6
    and the revenue 0.45 to 1.85 of the neighbours' mean; neither neighbour is a reported whole only.
    """
    df = _named(quarters, stable_names, "revenue", "source", "schema", "family").withColumn("missing", F.array_except("had", "have"))
    mean = (F.col("before_revenue") + F.col("after_revenue")) / 2
    fits = _next_to() & (F.col("source") == "official-segments") & (F.col("before_source") != "fallback-reported") & (F.col("after_source") != "fallback-reported")
    fits = fits & F.coalesce("coverage", F.lit(1.0)).between(0.72, 1.6) & (F.col("revenue") / mean).between(0.45, 1.85)
    df = _with_missing(df.withColumn("fits", F.coalesce(fits, F.lit(False)))).withColumn("completed", F.when(F.col("fits") & (F.size("missing") > 0) & (F.size(F.array_except("have", "had")) == 0), F.col("completed")))
    told = _alternate(with_made(df, blended(F.col("had")), F.col("fits")), F.col("fits") & (F.col("completed").isNotNull() | (F.size("made") > 0)))
    gap = F.col("turn") & F.col("completed").isNotNull()
    out = _set(told, F.col("turn") & F.col("completed").isNull(), rows=F.col("made"), filled=F.lit(True), smoothed=F.lit(True), schema=F.col("before_schema"), family=F.col("before_family"), notes=noted("strict-sandwich-harmonized"))
    return _state(_set(out, gap, rows=F.col("completed"), filled=F.lit(True), notes=noted("strict-sandwich-gap-filled")))


def sandwich_groups(quarters: DataFrame) -> DataFrame:
    """reported groups, fully covered, that can be aligned to the segments that both neighbours agree on."""
    df = _named(quarters, stable_names, "revenue", "schema", "family")
    fits = _next_to() & (F.col("source") == "official-groups") & F.coalesce("coverage", F.lit(1.0)).between(0.95, 1.05)
    pair = df.withColumns({"fits": F.coalesce(fits, F.lit(False)), "own": _slim(), "anchor": F.lag(_slim()).over(_order())})
    told = with_fit(aligned(pair), "aligned", F.lit(0.62))
    able = F.col("fits") & F.col("comparable") & (stable_names(F.col("aligned")) == F.col("had"))
    return _state(_set(_alternate(told, able), F.col("turn"), rows=F.col("fit_rows"), filled=F.lit(True), schema=F.col("before_schema"), family=F.col("before_family"), notes=noted("strict-official-groups-aligned")))


def rebalanced(quarters: DataFrame) -> DataFrame:
    """a quarter of its neighbours' members whose shares are off by over 0.3, one above 0.68, takes their mean shares.

    Its revenue is below 1.3 times theirs; it isn't smoothed, nor reported in full (coverage 0.94 to 1.12, a rest of 0.05 at
    most, neither filled nor imputed). The shares before are those that are left there by then.
    """
    df = _named(quarters, names, "revenue")
    rest = amount(F.col("rows"), F.lit(REST)) / F.greatest(F.col("revenue"), F.lit(0.001))
    trusted = F.col("given") & ~F.col("whole_only") & ~F.col("partial") & ~F.col("filled") & ~F.col("imputed") & ~F.col("source").isin("fallback-reported", "none") & ~conceptual() & F.coalesce("coverage", F.lit(1.0)).between(0.94, 1.12) & (rest <= 0.05)
    mean = (F.col("before_revenue") + F.col("after_revenue")) / 2
    df = df.withColumns({"own_shares": shares(F.col("rows")), "after_shares": shares(F.col("after_rows"))})
    top = F.aggregate("own_shares", F.lit(0.0), lambda a, x: F.greatest(a, x["value"]))
    fits = (F.least(F.size("rows"), F.size("before_rows"), F.size("after_rows")) >= 2) & (F.col("revenue") > 0.02) & (F.col("had") == F.col("have")) & (F.col("have") == F.col("will"))
    fits = fits & ~trusted & (top > 0.68) & ((mean <= 0.02) | (F.col("revenue") / mean < 1.3)) & ~F.col("smoothed")
    df = df.withColumn("turn", F.coalesce(fits, F.lit(False)))
    expected = lambda before, x, m: (share(before, m) + amount(x["after_shares"], m)) / 2

    def rows(before: Column, x: Column) -> Column:
        off = F.aggregate(x["own_shares"], F.lit(0.0), lambda a, r: F.greatest(a, F.abs(r["value"] - expected(before, x, r["member"]))))
        values = F.transform(x["rows"], lambda r: row(r["member"], rounded(x["revenue"] * F.least(expected(before, x, r["member"]), F.lit(1.0)))))
        return F.when(x["turn"] & (off > 0.3), largest_first(first_takes(values, rounded(x["revenue"] - total(values))))).otherwise(x["rows"])

    told = in_order(df.withColumn("given_rows", F.col("rows")).select("company", "q_ord", *STATE, "turn", "own_shares", "after_shares", "given_rows"), rows)
    return _state(_set(told, F.col("rows") != F.col("given_rows"), smoothed=F.lit(True), notes=noted("neighbor-share-rebalanced")))


def sandwich_repairs(quarters: DataFrame) -> DataFrame:
    """the three repairs between two agreeing neighbours, one after the other."""
    return rebalanced(sandwich_groups(sandwich_segments(quarters)))


# ---------------------------------------------------------------- F22: templates

POOL = ["at", "then", "main", "n_main"]


def pooled(quarters: DataFrame) -> DataFrame:
    """quarters with `at` (their place), `then` (the phase they are in, if they are reliable, else -1), `main` (the phase of most reliable ones) and `n_main`.

    Reliable: reported, in full (0.78 to 1.22) or in one style, two members or more where any quarter has them. -2: reliable,
    in no phase.
    """
    many = F.max((F.size("rows") >= 2).cast("int")).over(_company()) > 0
    sound = F.col("style").isNotNull() | ((F.col("source") != "fallback-reported") & F.coalesce("coverage", F.lit(0.0)).between(0.78, 1.22))
    reliable = F.col("given") & ~F.col("whole_only") & ~F.col("partial") & ~conceptual() & (F.size("rows") >= F.when(many, 2).otherwise(1)) & sound
    placed = quarters.withColumns({"at": F.row_number().over(_order()), "then": F.when(~reliable, -1).otherwise(F.coalesce("phase", F.lit(-2)))})
    counted = placed.withColumn("_n", F.when(F.col("then") >= 0, F.count(F.lit(1)).over(Window.partitionBy("company", "then"))))
    return counted.withColumn("_main", F.min(F.when(F.col("_n").isNotNull(), F.struct((-F.col("_n")).alias("less"), F.col("then").alias("phase")))).over(_company())).withColumns({"main": F.col("_main.phase"), "n_main": F.coalesce(-F.col("_main.less"), F.lit(0))}).drop("_n", "_main")


def _with_pool(quarters: DataFrame) -> DataFrame:
    candidate = F.struct("at", F.col("then"), "schema", "family", "rows")
    return quarters.withColumn("pool", F.array_sort(F.collect_list(F.when(F.col("then") != -1, candidate)).over(_company())))


def _nearest(fits: Callable[[Column], Column]) -> Column:
    """The place of the pool's nearest quarter that fits, the earlier of two."""
    return F.array_min(F.transform(F.filter("pool", fits), lambda x: F.struct(F.abs(x["at"] - F.col("at")).alias("off"), x["at"].alias("at"))))["at"]


def _from_template(df: DataFrame, phase: str, where: Column) -> DataFrame:
    """df (template: a place) with `made`: the revenue by the template's shares, where that holds.

    Outside its phase (the column names it; the pool's own is of the time when it was gathered) the mean shares of the phase's
    three quarters on that side count.
    """
    own = F.filter("pool", lambda x: x["at"] == F.col("template"))
    df = df.withColumn("_own", own).withColumn("_of", F.filter("pool", lambda x: (x["then"] >= 0) & (x["then"] == F.col(phase)))).withColumn("_of", F.when(F.size("_of") > 0, F.col("_of")).otherwise(F.col("_own")))
    side = F.when(F.col("at") < F.get("_of", F.lit(0))["at"], F.slice("_of", 1, 3)).when(F.col("at") > F.element_at("_of", -1)["at"], F.slice("_of", F.greatest(F.size("_of") - 2, F.lit(1)), 3)).otherwise(F.slice("_of", 1, 0))
    df = df.withColumn("_side", F.filter(F.transform(F.when(F.size("_of") > 0, side), lambda x: x["rows"]), lambda r: F.size(r) >= 2)).withColumn("_side", F.when(F.size("_side") > 0, F.col("_side")).otherwise(F.transform("_own", lambda x: x["rows"])))
    order = F.array_distinct(F.flatten(F.transform("_side", lambda r: F.transform(r, lambda x: x["member"]))))
    mean = F.transform(order, lambda m: row(m, F.aggregate("_side", F.lit(0.0), lambda a, r: a + share(r, m)) / F.size("_side")))
    return with_made(df, mean, where & (F.size("_side") > 0)).drop("_own", "_of", "_side")


def template_fill(quarters: DataFrame) -> DataFrame:
    """quarters (with POOL) that lack segments take a template's shares, 16 places away at most, or 4 within a style.

    The template is the nearest reliable quarter of the schema, else of the phase, of the family, or before, or after. Beyond a
    style the quarter is coarse, and the template of the main phase, which has six quarters or more.
    """
    df = _with_pool(quarters)
    alike = lambda p: (p["family"] == F.col("family")) & (F.col("phase").isNull() | (p["then"] == F.col("phase")))
    tiers = (lambda p: p["schema"] == F.col("schema"), lambda p: p["then"] == F.col("phase"), alike, lambda p: p["at"] < F.col("at"), lambda p: p["at"] > F.col("at"))
    styled, big = F.col("style").isNotNull(), F.col("n_main") >= 6
    needs = (F.col("revenue") > 0.02) & ((F.size("rows") < 2) | F.col("whole_only") | F.col("partial") | conceptual())
    df = df.withColumns({"coarse": coarse(), "needs": needs, "_main_at": _nearest(lambda p: p["then"] == F.col("main"))})
    df = df.withColumn("template", F.coalesce(F.when(~styled & big & F.col("coarse"), F.col("_main_at")), *map(_nearest, tiers)))
    df = df.withColumn("of", F.get(F.filter("pool", lambda p: p["at"] == F.col("template")), F.lit(0))).withColumn("of_phase", F.when(F.col("of.then") >= 0, F.col("of.then")))
    may = styled | ((F.col("of_phase") == F.col("main")) & big & F.col("coarse"))
    df = _from_template(df, "of_phase", F.coalesce(F.col("needs") & may & (F.abs(F.col("template") - F.col("at")) <= F.when(styled, 4).otherwise(16)), F.lit(False)))
    new = {"rows": F.col("made"), "filled": F.lit(True), "imputed": ~styled, "phase": F.coalesce("phase", "of_phase"), "schema": F.col("of.schema"), "family": F.col("of.family"), "notes": noted("template-harmonized")}
    return _set(df, F.size("made") > 0, **new).select("company", "q_ord", *STATE, *POOL)


def late_fill(quarters: DataFrame) -> DataFrame:
    """with six quarters or more and three quarters of the pool in the main phase, reported wholes take its nearest quarter's shares.

    quarters have POOL of before, and the phases and rows of now; what the template's phase of now was then says which quarters
    are averaged.
    """
    df = _with_pool(quarters)
    only = (F.col("revenue") > 0.02) & (F.size("rows") == 1) & F.exists("rows", lambda r: r["member"] == WHOLE) & (F.col("n_main") >= 6) & (F.col("n_main") / F.size("pool") >= 0.75)
    now = F.collect_list(F.struct("at", "phase")).over(_company())
    df = df.withColumns({"template": _nearest(lambda p: p["then"] == F.col("main")), "_now": now}).withColumn("of_phase", F.get(F.filter("_now", lambda p: p["at"] == F.col("template")), F.lit(0))["phase"])
    df = _from_template(df, "of_phase", F.coalesce(only & F.col("template").isNotNull(), F.lit(False)))
    return _state(_set(df, F.size("made") > 0, rows=F.col("made"), filled=F.lit(True), imputed=F.lit(True), phase=F.coalesce("phase", "main"), notes=noted("template-harmonized")))


# ---------------------------------------------------------------- F24, F26, F27: the history


def _only_note(note: str) -> Column:
    return F.when(F.size("notes") == 0, F.array(F.lit(note))).otherwise(F.col("notes"))


def single_gaps(quarters: DataFrame) -> DataFrame:
    """Where any quarter has two members, one alone, though segments were reported, is a part."""
    many = F.max((F.size("rows") >= 2).cast("int")).over(_company()) > 0
    told = quarters.withColumn("_single", many & (F.size("rows") == 1) & (F.col("revenue") > 0.02) & F.col("given") & ~F.col("whole_only"))
    return _state(_set(told, F.col("_single"), partial=F.lit(True), notes=_only_note("single-segment-gap")))


def promoted(quarters: DataFrame) -> DataFrame:
    """Filled rows count as given where there was only a whole, a part or concepts."""
    use = F.col("filled") & (F.size("rows") > 0) & (F.col("whole_only") | F.col("partial") | conceptual())
    return _set(quarters, use, raw=F.col("rows"), coverage=F.lit(1.0), partial=F.lit(False), whole_only=F.lit(False), given=F.lit(True))


def without_weak_rows(quarters: DataFrame) -> DataFrame:
    """segments that cover less than 0.72 and leave over 0.28 go; else optional rows of less than 0.015."""
    whole = F.greatest(F.col("revenue"), F.lit(0.001))
    weak = F.col("style").isNull() & (F.col("source") == "official-segments") & (F.coalesce("coverage", F.lit(0.0)) < 0.72) & (amount(F.col("rows"), F.lit(REST)) / whole > 0.28)
    df = quarters.withColumn("_weak", (F.col("revenue") > 0.02) & weak)
    tiny = F.filter("rows", lambda r: ~(optional(r["member"]) & (r["value"] / whole < 0.015)))
    df = _set(df, (F.col("revenue") > 0.02) & ~F.col("_weak"), rows=tiny)
    return _set(df, F.col("_weak"), rows=no_rows(), given=F.lit(False), partial=F.lit(True), notes=noted("residual-dominant")).drop("_weak")


def whole_if_none(quarters: DataFrame) -> DataFrame:
    return _set(quarters, (F.size("rows") == 0) & (F.col("revenue") > 0.02), rows=F.array(row(F.lit(WHOLE), F.col("revenue"))), notes=_only_note("fallback-single-segment"))


def repaired(quarters: DataFrame) -> DataFrame:
    """quarters (as quarter_rows has them) through all repairs in order; each sees what the ones before it made."""
    start = cut(pooled(single_gaps(with_phases(quarters))))
    pool = start.select("company", "q_ord", *POOL)
    gaps = neighbour_schemas(stable_gaps(_state(start)))
    filled = cut(promoted(_state(template_fill(gaps.join(pool, ["company", "q_ord"])))))
    again = cut(without_weak_rows(with_phases(filled)))
    late = late_fill(whole_if_none(absorbed_rests(again)).join(pool, ["company", "q_ord"]))
    return sandwich_repairs(cut(late))


def history(quarters: DataFrame, n_quarters: int = 30, most_members: int = 9) -> DataFrame:
    """company, q_ord, revenue, member, value, rank of each company's last n_quarters, repaired over its whole history.

    Members beyond `most_members` are one: the largest by their total stay, one fewer, the others are joined, if over 0.02.
    rank: by total over the quarters shown, from 1; ties go to the name that comes first.
    """
    last = repaired(quarters).withColumn("_back", F.row_number().over(_company().orderBy(F.desc("q_ord")))).filter(F.col("_back") <= n_quarters)
    cells = last.select("company", "q_ord", "revenue", F.inline("rows"))
    largest = _company().orderBy(F.desc(rounded(F.col("_sum"))), "member")
    sums = cells.groupBy("company", "member").agg(F.sum("value").alias("_sum")).withColumns({"_place": F.row_number().over(largest), "_n": F.count(F.lit(1)).over(_company())})
    kept = sums.select("company", "member", ((F.col("_n") <= most_members) | (F.col("_place") < most_members)).alias("_kept"))
    named = cells.join(kept, ["company", "member"]).withColumn("member", F.when(F.col("_kept"), F.col("member")).otherwise(OTHERS))
    joined = named.groupBy("company", "q_ord", "revenue", "member").agg(rounded(F.sum("value")).alias("value")).filter((F.col("member") != OTHERS) | (F.col("value") > 0.02))
    ranks = joined.groupBy("company", "member").agg(F.sum("value").alias("_sum")).select("company", "member", F.row_number().over(largest).alias("rank"))
    return joined.join(ranks, ["company", "member"]).select("company", "q_ord", "revenue", "member", "value", "rank")


def business_groups(quarters: DataFrame, scale: DataFrame) -> DataFrame:
    """a quarter's repaired members of over 0.02, two or more, in its own currency: value over the scale (company, q_ord, scale)."""
    own = F.filter("rows", lambda x: (x["member"] != WHOLE) & (x["value"] > 0.02))
    cells = repaired(quarters).filter(F.size(own) >= 2).select("company", "q_ord", F.inline(own)).join(scale, ["company", "q_ord"])
    return cells.select("company", "q_ord", "member", rounded(F.col("value") / F.greatest(F.col("scale"), F.lit(0.000001))).alias("value"))

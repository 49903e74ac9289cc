"""A company's dataset as one plan of named steps (F32)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.bridge import BRIDGE_FIELDS, merge_fallback
from tallyloom.operators.fusion import fuse

Parts = dict[str, DataFrame]
KEYS = ["company", "q_ord"]
#: Fields that a quarter can't do without.
REQUIRED = ("revenue", "op_income", "net")


def _rounded(x: Column) -> Column:
    """To thousandths, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def reconcile(parts: Parts, state: DataFrame | None) -> DataFrame:
    """The best candidate of each field (E1), a column each."""
    best = fuse(parts["candidates"])
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    return best.groupBy(*KEYS).agg(*map(pick, BRIDGE_FIELDS), F.first(F.lit("official")).alias("source"))


def derive(parts: Parts, state: DataFrame) -> DataFrame:
    """Fields that two others give (F1): gross profit and costs, then what rests on them."""
    c = F.col
    first = {"gross": c("revenue") - c("cost"), "cost": c("revenue") - c("gross")}
    second = {"opex": c("gross") - c("op_income"), "op_income": c("gross") - c("opex"), "pretax": c("net") + c("tax"), "net": c("pretax") - c("tax"), "tax": c("pretax") - c("net")}
    given = lambda sums: {f: F.coalesce(f, _rounded(v)) for f, v in sums.items()}
    return state.withColumns(given(first)).withColumns(given(second))


def attach(parts: Parts, state: DataFrame) -> DataFrame:
    """The sum and number of a quarter's segments."""
    sums = parts["segments"].groupBy(*KEYS).agg(_rounded(F.sum("value")).alias("segment_sum"), F.count(F.lit(1)).alias("n_segments"))
    return state.drop("segment_sum", "n_segments").join(sums, KEYS, "left")


def fall_back(parts: Parts, state: DataFrame) -> DataFrame:
    """A second source for what is missing or broken."""
    return merge_fallback(state, parts["fallback"])


def clear(parts: Parts, state: DataFrame) -> DataFrame:
    """Stages above 1.18 times the revenue take the whole bridge with them (D14); `cleared` tells."""
    stages = ("cost", "gross", "opex", "op_income", "pretax", "net")
    bad = F.coalesce(F.greatest(*stages) > F.col("revenue") * 1.18, F.lit(False)) & (F.col("revenue") > 0)
    told = state.withColumn("cleared", bad)
    return told.withColumns({f: F.when(~F.col("cleared"), F.col(f)) for f in BRIDGE_FIELDS if f != "revenue"})


def override(parts: Parts, state: DataFrame) -> DataFrame:
    """Values given by hand come before all others."""
    given = parts["overrides"].groupBy(*KEYS).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in BRIDGE_FIELDS))
    return state.join(given, KEYS, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in BRIDGE_FIELDS}).drop(*(f"_{f}" for f in BRIDGE_FIELDS))


def display(parts: Parts, state: DataFrame) -> DataFrame:
    """Revenue in the display currency, by the company's rate of the quarter (1 if there is none)."""
    return state.join(parts["rates"], KEYS, "left").withColumn("display_revenue", _rounded(F.col("revenue") * F.coalesce("rate", F.lit(1.0)))).drop("rate")


def grow(parts: Parts, state: DataFrame) -> DataFrame:
    """Growth over the quarter of a year before, in per cent (G1)."""
    before = F.max("revenue").over(Window.partitionBy("company").orderBy("q_ord").rangeBetween(-4, -4))
    return state.withColumn("revenue_yoy", F.when((before > 0) & (F.col("revenue") > 0), _rounded((F.col("revenue") / before - 1) * 100)))


def diagnose(parts: Parts, state: DataFrame) -> DataFrame:
    """What is missing, whether segments are explicit, and how much of the revenue they cover."""
    lacking = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED)))
    issues = F.when(F.size(lacking) > 0, F.concat(F.lit("missing-required:"), F.array_join(lacking, ",")))
    return state.withColumns({"issues": issues, "segments_mode": F.when(F.col("n_segments") > 0, "explicit").otherwise("none"), "segment_share": F.when(F.col("revenue") > 0, _rounded(F.col("segment_sum") / F.col("revenue")))})


#: The steps in order; what the fallback brings is derived, attached and cleared like the rest, so these run again after it.
PLAN: tuple[tuple[str, Callable[[Parts, DataFrame | None], DataFrame]], ...] = (
    ("reconcile", reconcile), ("derive", derive), ("attach segments", attach), ("fallback", fall_back), ("derive again", derive), ("attach segments again", attach), ("clear", clear), ("override", override), ("display currency", display), ("growth", grow), ("diagnose", diagnose),
)


def dataset(parts: Parts, plan=PLAN, upto: str | None = None) -> DataFrame:
    """F32: the state after the plan's last step, or the one named.

    parts: candidates (as fuse takes them), segments, fallback (a column a field, source), overrides (field, value), rates. A step
    is a function of these and of the state before it, so the whole is one lazy plan that Spark optimises.
    """
    state = None
    for name, step in plan:
        state = step(parts, state)
        if name == upto:
            break
    return state

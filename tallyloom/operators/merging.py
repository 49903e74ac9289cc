"""Merging whole records: representative entries, ordered coalescing, overlays, upserts, staleness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import quarter_ordinal


def representative(entries: DataFrame, fields: list[str]) -> DataFrame:
    """The fullest entry of each (company, q_ord), of equal ones the earlier source's.

    score: known fields, 0.2 for each of up to six breakdown rows, 0.5 with a url, 0.25 with flags, a hundredth of the priority.
    """
    known = reduce(lambda a, b: a + b, (F.col(f).isNotNull().cast("int") for f in fields))
    score = F.round(known + 0.2 * F.least(F.col("n_breakdown"), F.lit(6)) + 0.5 * F.col("has_url").cast("int") + 0.25 * F.col("has_flags").cast("int") + F.col("priority") / 100, 6)
    best = entries.groupBy("company", "q_ord").agg(F.max_by(F.struct("source", score.alias("score"), *fields), F.struct(score, -F.col("source_order"))).alias("_best"))
    return best.select("company", "q_ord", "_best.*")


def coalesce_order(entries: DataFrame, fields: list[str]) -> DataFrame:
    """E5: each field from the first source that has it, with that source's name; the template is the first source with an entry.

    Entries have one row for each (company, q_ord, source). n_overrides counts fields another source than the template's gave.
    """
    first = [F.min_by(F.struct(F.col(f).alias("value"), "source"), F.when(F.col(f).isNotNull(), F.col("source_order"))).alias(f"_{f}") for f in fields]
    merged = entries.groupBy("company", "q_ord").agg(F.min_by("source", "source_order").alias("template"), *first)
    overrides = reduce(lambda a, b: a + b, (F.coalesce((F.col(f"_{f}.source") != F.col("template")).cast("long"), F.lit(0)) for f in fields))
    return merged.select("company", "q_ord", "template", *(F.col(f"_{f}.value").alias(f) for f in fields), *(F.col(f"_{f}.source").alias(f"{f}_source") for f in fields), overrides.alias("n_overrides"))


def source_usage(merged: DataFrame, fields: list[str]) -> DataFrame:
    """E5: how many fields each source gave, and in how many quarters beside another source."""
    used = F.filter(F.array(*(F.col(f"{f}_source") for f in fields)), lambda s: s.isNotNull())
    rows = merged.select(used.alias("_used"), (F.size(F.array_distinct(used)) > 1).cast("long").alias("_mixed"))
    by_quarter = rows.select("_used", "_mixed", F.explode(F.array_distinct("_used")).alias("source"))
    own = F.size(F.filter("_used", lambda s: s == F.col("source"))).cast("long")
    return by_quarter.groupBy("source").agg(F.sum(own).alias("n_fields"), F.sum("_mixed").alias("n_mixed"))


def outer_merge(statements: DataFrame, revenues: DataFrame, shared: list[str]) -> DataFrame:
    """All quarters of both sides; on shared fields the revenue side wins where it has a value."""
    other = revenues.select("company", "q_ord", *(F.col(c).alias(f"_{c}") for c in revenues.columns if c not in ("company", "q_ord")))
    both = statements.join(other, ["company", "q_ord"], "full_outer")
    own = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in statements.columns if c not in ("company", "q_ord")]
    return both.select("company", "q_ord", *own, *(F.col(f"_{c}").alias(c) for c in revenues.columns if c not in statements.columns))


def fill_only(target: DataFrame, unified: DataFrame, fields: list[str]) -> DataFrame:
    """The target's nulls from the unified entry; quarters it lacks come in where they hold any field.

    filled lists the fields that were taken, in the order of `fields`; no others are recorded.
    """
    other = unified.select("company", "q_ord", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_there"))
    both = target.withColumn("_own", F.lit(True)).join(other, ["company", "q_ord"], "full_outer")
    usable = reduce(lambda a, b: a | b, (F.col(f"_{f}").isNotNull() for f in fields))
    filled = F.array_join(F.array(*(F.when(F.col(f).isNull() & F.col(f"_{f}").isNotNull(), F.lit(f)) for f in fields)), ",")
    return both.filter(F.col("_own").isNotNull() | usable).select("company", "q_ord", *(F.coalesce(F.col(f), F.col(f"_{f}")).alias(f) for f in fields), filled.alias("filled"))


def overlay(base: DataFrame, defaults: DataFrame, own: DataFrame, fields: list[str]) -> DataFrame:
    """A company's default row over the base, and the quarter's own row over both; nulls override nothing."""
    general = defaults.select("company", *(F.col(f).alias(f"_d_{f}") for f in fields))
    special = own.select("company", "q_ord", *(F.col(f).alias(f"_q_{f}") for f in fields))
    both = base.join(general, "company", "left").join(special, ["company", "q_ord"], "left")
    return both.select("company", "q_ord", *(F.coalesce(F.col(f"_q_{f}"), F.col(f"_d_{f}"), F.col(f)).alias(f) for f in fields))


def merge_maps(base: Column, override: Column) -> Column:
    """C14: two maps as one; the right value wins unless null."""
    return F.map_zip_with(base, override, lambda k, a, b: F.coalesce(b, a))


def preserve_missing(fresh: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """The fresh rows and those cached ones whose key no fresh row has."""
    return fresh.unionByName(cached.join(fresh.select(*keys).distinct(), keys, "left_anti").select(*fresh.columns))


def preserve_lists(fresh: DataFrame, cached: DataFrame, lists: list[str]) -> DataFrame:
    """Fresh quarters, whose empty or null lists come from the cached ones, and the cached quarters that the fresh ones lack."""
    keys, others = ["company", "q_ord"], [c for c in fresh.columns if c not in ("company", "q_ord")]
    old = cached.select(*keys, *(F.col(c).alias(f"_{c}") for c in others), F.lit(True).alias("_old"))
    both = fresh.withColumn("_new", F.lit(True)).join(old, keys, "full_outer")
    own = F.col("_new").isNotNull()
    kept = {c: F.when(~F.coalesce(own, F.lit(False)), F.col(f"_{c}")).otherwise(F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))) if c in lists else F.col(c)) for c in others}
    return both.select(*keys, *(kept[c].alias(c) for c in others))


def merge_filings(fresh: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Filings of both sides by accession, each field the fresh one's if it has any; rows without an accession go."""
    others = [c for c in fresh.columns if c != key]
    old = cached.filter(F.col(key) != "").select(key, *(F.col(c).alias(f"_{c}") for c in others))
    return fresh.filter(F.col(key) != "").join(old, key, "full_outer").select(key, *(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in others))


def loose_quarter(entries: DataFrame, financials: DataFrame) -> DataFrame:
    """The quarter of an entry (entry, company, period_end, revenue; quarter, a label, if it has one): that of its own label, else the
    first of the company's that ends on the same day and whose revenue is within 0.002, or unknown on either side; null if none."""
    label = F.col("quarter") if "quarter" in entries.columns else F.lit(None).cast("string")
    named = entries.select("entry", "company", "period_end", "revenue", quarter_ordinal(label).alias("_own"))
    known = financials.select("company", "period_end", "q_ord", F.col("revenue").alias("_revenue"))
    near = F.col("revenue").isNull() | F.col("_revenue").isNull() | (F.abs(F.col("revenue") - F.col("_revenue")) < 0.002)
    return named.join(known, ["company", "period_end"], "left").groupBy("entry").agg(F.coalesce(F.max("_own"), F.min(F.when(near, F.col("q_ord")))).alias("q_ord"))


def null_bridge(df: DataFrame, stages: list[str], bridge: list[str], flag: str, cleared: str) -> DataFrame:
    """Entries (flags: array) with `flag` and revenue above zero, whose largest stage is above 1.18 times it, lose all bridge
    fields and get the flag `cleared`."""
    most = F.array_max(F.filter(F.array(*(F.col(s).cast("double") for s in stages)), lambda v: v > 0))
    bad = F.coalesce(F.array_contains("flags", flag) & (F.col("revenue") > 0) & (most > F.col("revenue") * 1.18), F.lit(False))
    marked = df.withColumn("_bad", bad)
    nulled = {f: F.when(~F.col("_bad"), F.col(f)) for f in bridge}
    return marked.withColumns(nulled | {"flags": F.when(F.col("_bad"), F.array_union("flags", F.array(F.lit(cleared)))).otherwise(F.col("flags"))}).drop("_bad")


def attach(entries: DataFrame, structures: DataFrame, how: str = "synthesise") -> DataFrame:
    """Entries (company, q_ord, revenue, rows) with the rows of structures (company, q_ord, display_revenue, rows: array of member,
    value).

    `synthesise`: the structure's rows win, and quarters without an entry get one, with the displayed revenue or else the sum of
    the rows above zero (3 digits), unless that is zero. `fill`: only entries without rows take them. `inner`: as the first, but only
    quarters with an entry stay. `source` tells whose the entry is.
    """
    other = structures.select("company", "q_ord", "display_revenue", F.col("rows").alias("_rows"))
    both = entries.withColumn("_own", F.lit(True)).join(other, ["company", "q_ord"], {"synthesise": "full_outer", "fill": "left", "inner": "left"}[how])
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rows = F.when(has(F.col("rows")), F.col("rows")).otherwise(F.col("_rows")) if how == "fill" else F.when(has(F.col("_rows")), F.col("_rows")).otherwise(F.col("rows"))
    total = F.round(F.aggregate(F.filter("_rows", lambda r: r["value"] > 0), F.lit(0.0), lambda a, r: a + r["value"]), 3)
    made = F.when(F.col("display_revenue") > 0, F.round("display_revenue", 3)).otherwise(total)
    own = F.col("_own").isNotNull()
    out = both.filter(own | (made > 0))
    return out.select("company", "q_ord", F.when(own, F.col("revenue")).otherwise(made).alias("revenue"), F.coalesce(rows, "rows", "_rows").alias("rows"), F.when(own, "entry").otherwise("structure").alias("source"))


def by_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """The company of each query (query), from aliases (alias, company, source_order, position), all normalised.

    The first source that has any decides: its first company with an equal alias, else its first one of which an alias lies in the
    query or the query in an alias. Empty ones match nothing. Contained ones meet by their first three characters (all, if they
    have fewer), offered at each place of the longer one, so the join is on equal keys.
    """
    asked = queries.select("query").filter("query <> ''").distinct()
    known = aliases.filter("alias <> ''").distinct()
    head = lambda c: F.substring(c, 1, 3)
    offered = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr(c, i, n))))))
    in_query = asked.withColumn("_key", offered(F.col("query"))).join(known.withColumn("_key", head("alias")), "_key").filter(F.col("query").contains(F.col("alias")))
    in_alias = known.withColumn("_key", offered(F.col("alias"))).join(asked.withColumn("_key", head("query")), "_key").filter(F.col("alias").contains(F.col("query")))
    order = F.struct("source_order", F.col("query") != F.col("alias"), "position", "company")
    found = in_query.select("query", *aliases.columns).unionByName(in_alias.select("query", *aliases.columns)).groupBy("query").agg(F.min_by(F.struct("company", (F.col("query") == F.col("alias")).alias("exact")), order).alias("_best"))
    return queries.join(found, "query", "left").select(*queries.columns, F.col("_best.company").alias("company"), F.col("_best.exact").alias("exact"))


def lookup_number(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """Each row's (ticker) number from (ticker, number), by normalised ticker; of several the last by number."""
    plain = lambda c: F.regexp_replace(F.upper(F.trim(c)), "[./]", "-")
    known = tickers.filter(plain("ticker") != "").groupBy(plain("ticker").alias("_ticker")).agg(F.max("number").alias("number"))
    return rows.withColumn("_ticker", plain("ticker")).join(known, "_ticker", "left").drop("_ticker")


def largest_member(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the largest value's; of equal values the newer, then the smaller `order`."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("value", "filed", -F.col(order))).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def reporting_currency(votes: DataFrame) -> DataFrame:
    """The currency with most weighted facts of each company; a tie goes to another than USD, then to the larger name.

    A concept's facts weigh more the earlier it is in the list: its length plus 2 less its place.
    """
    sums = votes.groupBy("company", "currency").agg(F.sum(F.col("n_facts") * F.col("weight")).alias("score"))
    return sums.groupBy("company").agg(F.max_by(F.struct("currency", "score"), F.struct("score", F.col("currency") != "USD", "currency")).alias("_best")).select("company", "_best.*")


def first_success(attempts: DataFrame) -> DataFrame:
    """The first source that succeeded, and the statuses of those tried before it, in order; null where none did."""
    ordered = attempts.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("source_order", "source", "status"))).alias("_all"))
    good = F.filter("_all", lambda a: a["status"] == "success")
    chosen = F.try_element_at(good, F.lit(1))
    before = F.filter("_all", lambda a: chosen.isNull() | (a["source_order"] < chosen["source_order"]))
    return ordered.select("company", chosen["source"].alias("source"), F.array_join(F.transform(before, lambda a: F.concat(a["source"], F.lit(":"), a["status"])), ",").alias("fallback"))


def newest_marker(filings: DataFrame, key: str) -> DataFrame:
    """The newest (filed, accession) of each key."""
    return filings.groupBy(key).agg(F.max(F.struct("filed", "accession")).alias("_newest")).select(key, F.col("_newest.filed").alias("filed"), F.col("_newest.accession").alias("accession"))


def stale(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Whether the remote marker is newer, or of the same time and another accession, or unknown here."""
    mine = local.select(key, F.col("filed").alias("_filed"), F.col("accession").alias("_accession"))
    newer = F.col("_filed").isNull() | (F.col("filed") > F.col("_filed")) | ((F.col("filed") == F.col("_filed")) & (F.col("accession") != F.col("_accession")))
    return remote.join(mine, key, "left").select(key, newer.alias("stale"))


def incremental(rebuilt: DataFrame, cached: DataFrame, version: int, key: str) -> DataFrame:
    """M2: rebuilt rows, and cached ones of the current version whose key was not rebuilt."""
    return preserve_missing(rebuilt, cached.filter(F.col("version") == version), [key])


def unexpired(rows: DataFrame, now: Column, seconds: int) -> DataFrame:
    """M5: rows younger than `seconds`."""
    return rows.filter(F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds)))


def compare_members(rows: DataFrame, back: int = 1) -> DataFrame:
    """Members a quarter shares with the one `back` before, those it lacks and those it adds, as sizes."""
    sets = rows.groupBy("company", "q_ord").agg(F.collect_set("member").alias("own"))
    then = sets.select("company", (F.col("q_ord") + back).alias("q_ord"), F.col("own").alias("_then"))
    size = lambda a: F.size(a).cast("long")
    return sets.join(then, ["company", "q_ord"]).select("company", "q_ord", size(F.array_intersect("own", "_then")).alias("common"), size(F.array_except("_then", "own")).alias("missing"), size(F.array_except("own", "_then")).alias("extra"))


def union_distinct(a: Column, b: Column) -> Column:
    """The elements of both lists, each once, in order of first appearance."""
    return F.array_union(a, b)

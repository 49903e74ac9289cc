"""Queries over a supplier's revenue by type of part, quarter by quarter, and the SQL that gives the same rows.

The SQL of a step is made by a function of the table before it, so the whole history is the chain of its steps.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import revenue_history as history
from tallyloom.plans.queries import _Q
from tallyloom.sources.tables import _money, _net, quarter_of, read


def supplier_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies, types of parts as segments, in hundreds of thousands: sources as quarter_rows takes them.

    Revenue is of all lines, segments are of those with a discount. Quarters of fewer than twelve lines report their whole only,
    those of 26 or more groups. Suppliers of the first five nations have a style, those of the last five another currency.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), quarter_of("l_shipdate").alias("q_ord"), F.col("l_partkey").alias("p_partkey"), _net().alias("net"), (F.col("l_discount") > 0).alias("kept"))
    types = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    modes = types.groupBy("company", "q_ord", "p_type").agg(F.sum("net").alias("net"), F.sum(F.when(F.col("kept"), F.col("net"))).alias("kept"), F.count(F.lit(1)).alias("n"))
    large = lambda c: history.rounded(c.cast("double") / 100000)
    told = modes.groupBy("company", "q_ord").agg(large(F.sum("net")).alias("revenue"), F.sum("n").alias("n"), F.collect_list(F.when(F.col("kept").isNotNull(), history.row(F.col("p_type"), large(F.col("kept"))))).alias("modes"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company"), F.col("s_nationkey").alias("nation"))
    whole = F.array(history.row(F.lit(history.WHOLE), F.col("revenue")))
    return told.join(suppliers, "company").select(
        F.col("company").cast("long").alias("company"), "q_ord", "revenue", F.when(F.col("nation") < 5, "bridge").alias("style"), F.when(F.col("n") < 12, "fallback-reported").when(F.col("n") >= 26, "official-groups").otherwise("official-segments").alias("source"),
        F.lit(60.0).alias("score"), F.when(F.col("nation") >= 20, 0.5).otherwise(1.0).alias("scale"), F.when(F.col("n") < 12, whole).otherwise(F.col("modes")).alias("segments"),
    )


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.quarter_rows(supplier_quarters(spark, sf_dir))


def _shown(quarters: DataFrame) -> DataFrame:
    """A row for each member of each quarter, and one for a quarter without any."""
    flags = ("phase", "filled", "imputed", "smoothed", "partial")
    return quarters.select("company", "q_ord", *flags, F.array_join("notes", "+").alias("notes"), F.inline_outer("rows"))


def reconciled_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_quarters(spark, sf_dir))


def aligned_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quarter against the one before it."""
    slim = F.struct("q_ord", "raw", "revenue", "style")
    pair = _quarters(spark, sf_dir).select("company", "q_ord", slim.alias("own"), F.lag(slim).over(Window.partitionBy("company").orderBy("q_ord")).alias("anchor")).filter("anchor IS NOT NULL")
    return history.aligned(pair).select("company", "q_ord", "comparable", "reason", F.inline_outer("aligned"))


def bundle_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.phases(_quarters(spark, sf_dir))


def phase_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(history.with_phases(_quarters(spark, sf_dir)))


def template_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(history.template_fill(history.pooled(history.single_gaps(_quarters(spark, sf_dir)))))


def sandwich_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(history.sandwich_repairs(_quarters(spark, sf_dir)))


def revenue_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest members and the others, over 24 quarters."""
    return history.history(_quarters(spark, sf_dir), 24, 6)


def business_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = supplier_quarters(spark, sf_dir)
    return history.business_groups(history.quarter_rows(sources), sources.select("company", "q_ord", "scale"))


QUERIES = {f.__name__: f for f in (reconciled_quarters, aligned_quarters, bundle_phases, phase_alignment, template_fills, sandwich_repairs, revenue_history, business_groups)}

# ---------------------------------------------------------------- SQL

_names = count()
_SPECIAL = "('otherrevenue', 'reportedrevenue')"
_EMPTY = "CAST([] AS STRUCT(member VARCHAR, value DOUBLE)[])"
_NO_NOTES = "CAST([] AS VARCHAR[])"
_O = "OVER (PARTITION BY company ORDER BY q_ord)"


def _map(rows: str, body: str) -> str:
    """body of each element, which it calls $."""
    x = f"x{next(_names)}"
    return f"list_transform({rows}, lambda {x}: {body.replace('$', x)})"


def _keep(rows: str, body: str) -> str:
    x = f"x{next(_names)}"
    return f"list_filter({rows}, lambda {x}: {body.replace('$', x)})"


def _r3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


def _row(member: str, value: str) -> str:
    return f"{{member: {member}, value: {value}}}"


def _total(rows: str) -> str:
    return f"coalesce(list_sum({_map(rows, '$.value')}), 0)"


def _amount(rows: str, member: str) -> str:
    return f"coalesce(({_keep(rows, f'$.member = {member}')})[1].value, 0)"


def _share(rows: str, member: str) -> str:
    return f"CASE WHEN {_total(rows)} > 0.02 THEN {_amount(rows, member)} / {_total(rows)} ELSE 0 END"


def _desc(rows: str) -> str:
    ordered = f"list_sort({_map(rows, '{less: -$.value, member: $.member}')})"
    return _map(ordered, _row("$.member", "-$.less"))


def _members(rows: str) -> str:
    return f"list_sort(list_distinct({_map(rows, '$.member')}))"


def _stable(rows: str) -> str:
    return _keep(_members(rows), f"$ NOT IN {_SPECIAL}")


def _own(rows: str) -> str:
    return _keep(rows, f"$.value > 0.02 AND $.member NOT IN {_SPECIAL}")


def _comparable(rows: str) -> str:
    return f"CASE WHEN len({_own(rows)}) >= 2 THEN {_own(rows)} ELSE {_keep(rows, '$.value > 0.02 AND $.member <> ' + repr('reportedrevenue'))} END"


def _except(a: str, b: str) -> str:
    return _keep(a, f"NOT list_contains({b}, $)")


def _both(a: str, b: str) -> str:
    return _keep(a, f"list_contains({b}, $)")


def _first_takes(values: str, left: str) -> str:
    x, i = f"x{next(_names)}", f"i{next(_names)}"
    return f"list_transform({values}, lambda {x}, {i}: {_row(f'{x}.member', f'CASE WHEN {i} = 1 AND abs({left}) > 0.004 THEN {_r3(f'{x}.value + {left}')} ELSE {x}.value END')})"


class _Sql:
    """CTEs, one after the other; every step reads the last one."""

    def __init__(self) -> None:
        self.ctes: list[str] = []
        self.last = ""

    def add(self, body: str, name: str | None = None, recursive: bool = False) -> str:
        self.last = name or f"t{len(self.ctes)}"
        self.ctes.append(f"{self.last} AS {'' if recursive else 'MATERIALIZED '}({body})")
        return self.last

    def more(self, **columns: str) -> str:
        return self.add(f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {self.last}")

    def set(self, when: str, **columns: str) -> str:
        self.more(when_=f"coalesce({when}, false)")
        return self.add(f"SELECT * EXCLUDE (when_) REPLACE ({', '.join(f'CASE WHEN when_ THEN {v} ELSE {k} END AS {k}' for k, v in columns.items())}) FROM {self.last}")

    def drop(self, *columns: str) -> str:
        return self.add(f"SELECT * EXCLUDE ({', '.join(columns)}) FROM {self.last}")

    def state(self) -> str:
        return self.add(f"SELECT company, q_ord, {', '.join(_STATE)} FROM {self.last}")

    def select(self, body: str) -> str:
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT {body.replace('$', self.last)}"


_STATE = ["revenue", "style", "source", "score", "raw", "rows_", "coverage", "partial_", "whole_only", "given", "sch", "fam", "phase", "filled", "imputed", "smoothed", "notes"]
_LEAST = "CASE WHEN style IS NULL THEN 0.62 ELSE 0.36 END"
_CONCEPTUAL = "false"  # no type is a concept
_COARSE = f"(len(raw) = 0 OR whole_only OR len({_own('raw')}) <= 1)"


def _noted(note: str) -> str:
    return f"CASE WHEN list_contains(notes, {note}) THEN notes ELSE list_append(notes, {note}) END"


def _fit(s: _Sql, rows: str, least: str) -> None:
    s.more(whole_=_total(rows))
    s.more(left_="revenue - whole_", fit_note=f"CASE WHEN NOT (revenue > 0.02 AND len({rows}) > 0) THEN 'none' WHEN whole_ / revenue < {least} THEN 'coverage-too-low' WHEN whole_ / revenue > 1.12 THEN 'scaled-down' WHEN whole_ / revenue < 0.94 AND revenue - whole_ > 0.03 THEN 'residual-added' ELSE 'none' END")
    scaled = _map(rows, _row("$.member", _r3("$.value * (revenue / whole_)")))
    joined = _map(rows, _row("$.member", f"CASE WHEN $.member = 'otherrevenue' THEN {_r3('$.value + left_')} ELSE $.value END"))
    added = f"CASE WHEN list_contains({_members(rows)}, 'otherrevenue') THEN {joined} ELSE list_append({rows}, {_row(repr('otherrevenue'), _r3('left_'))}) END"
    s.more(fit_=f"CASE fit_note WHEN 'coverage-too-low' THEN {_EMPTY} WHEN 'scaled-down' THEN {scaled} WHEN 'residual-added' THEN {added} ELSE {rows} END")
    s.more(fit_rows=_desc("fit_"), fit_coverage="CASE WHEN revenue > 0.02 THEN whole_ / revenue END", fit_partial="fit_note = 'coverage-too-low'")
    s.drop("whole_", "left_", "fit_")


def _base() -> _Sql:
    s = _Sql()
    net = "CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"
    s.add(f"SELECT CAST(l_suppkey AS BIGINT) AS company, {_Q.format('l_shipdate')} AS q_ord, p_type AS member, sum({net}) AS net, sum({net}) FILTER (l_discount > 0) AS kept, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3")
    large = lambda c: _r3(f"CAST({c} AS DOUBLE) / 100000")
    s.add(f"SELECT company, q_ord, {large('sum(net)')} AS revenue, sum(n) AS n, list({_row('member', large('kept'))}) FILTER (kept IS NOT NULL) AS modes FROM {s.last} GROUP BY 1, 2")
    s.add(f"""SELECT t.company, q_ord, revenue, CASE WHEN s_nationkey < 5 THEN 'bridge' END AS style, CASE WHEN n < 12 THEN 'fallback-reported' WHEN n >= 26 THEN 'official-groups' ELSE 'official-segments' END AS source, 60.0::DOUBLE AS score,
        CASE WHEN s_nationkey >= 20 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale, CASE WHEN n < 12 THEN [{_row(repr('reportedrevenue'), 'revenue')}] ELSE modes END AS segs FROM {s.last} t JOIN supplier ON s_suppkey = t.company""", "sources")
    s.more(raw=_desc(_map(f"coalesce(segs, {_EMPTY})", _row("$.member", _r3("$.value * scale")))))
    own = _r3(f"CASE WHEN revenue > 0.02 THEN revenue * scale ELSE {_total('raw')} END")
    s.add(f"SELECT * REPLACE ({own} AS revenue) FROM {s.last}")
    s.add(f"SELECT *, {_members('raw')} AS keys FROM {s.last} WHERE revenue > 0.02 OR len(raw) > 0")
    _fit(s, "raw", _LEAST)
    s.add(f"""SELECT company, q_ord, revenue, style, source, score, raw, fit_rows AS rows_, fit_coverage AS coverage, fit_partial AS partial_, len(raw) = 1 AND coalesce(raw[1].member, '') = 'reportedrevenue' AS whole_only, len(raw) > 0 AS given,
        CASE WHEN style IS NOT NULL THEN 'style:' || style WHEN len(keys) > 0 THEN 'keys:' || array_to_string(keys, '|') ELSE 'schema:unknown' END AS sch,
        coalesce(style, CASE WHEN len(keys) >= 2 THEN 'legacy:' || array_to_string(keys[1:3], '|') WHEN len(keys) = 1 THEN 'single:' || keys[1] ELSE 'unknown' END) AS fam, CAST(NULL AS INTEGER) AS phase,
        false AS filled, false AS imputed, false AS smoothed, CASE WHEN fit_note = 'none' THEN {_NO_NOTES} ELSE [fit_note] END AS notes FROM {s.last}""")
    return s


def _align(s: _Sql) -> None:
    """o_ and a_ q, raw, revenue and style of each row: comparable, aligned, reason."""
    s.more(a=_comparable("a_raw"), o=_comparable("o_raw"))

    def sides() -> None:
        s.more(an=_members("a"), on_=_members("o"))
        s.more(miss=_except("an", "on_"), extra=_except("on_", "an"), common=_both("an", "on_"))

    held = lambda rows, members: _total(_keep(rows, f"list_contains({members}, $.member)"))
    aw, ow = "greatest(a_revenue, 0.001)", "greatest(o_revenue, 0.001)"
    sides()
    s.more(had=held("o_raw", "extra"), want=f"{held('a', 'miss')} / {aw}", n_o="len(o)")
    s.more(got=f"had / {ow}")
    s.more(bundle="len(miss) = 1 AND len(extra) BETWEEN 1 AND 3 AND len(common) >= 2 AND ((want > 0.1 AND got > 0.1 AND got / greatest(want, 0.001) BETWEEN 0.55 AND 1.8) OR abs(want - got) <= 0.18)")
    joined = f"list_append({_keep('o_raw', 'NOT list_contains(extra, $.member)')}, {_row('miss[1]', _r3('had'))})"
    s.more(all_=f"CASE WHEN bundle THEN {joined} ELSE o_raw END")
    s.add(f"SELECT * EXCLUDE (an, on_, miss, extra, common) REPLACE (CASE WHEN bundle THEN {_comparable('all_')} ELSE o END AS o) FROM {s.last}")
    sides()
    s.more(like_=f"""len(common) >= 2 AND (len(common) / greatest(len(an) + len(on_) - len(common), 1) >= 0.58 OR (o_style = a_style AND {held('a', 'common')} / {aw} >= 0.45)
        OR ({held('a', 'common')} / {aw} >= 0.55 AND {held('o', 'common')} / {ow} >= 0.55 AND {held('a', 'miss')} / {aw} <= 0.26 AND {held('o', 'extra')} / {ow} <= 0.26))""")
    s.more(reason="CASE WHEN o_q = a_q THEN 'anchor-quarter' WHEN o_style <> a_style THEN 'style-mismatch' WHEN len(a) < 2 OR n_o < 1 THEN 'insufficient-profile' WHEN NOT coalesce(like_, false) THEN 'schema-mismatch' WHEN bundle THEN 'schema-bundled' ELSE 'schema-compatible' END")
    x = f"x{next(_names)}"
    drop = f"list_filter(extra, lambda {x}: {x} IN {_SPECIAL} OR {_amount('o', x)} / {ow} <= 0.08)"
    s.more(gone=drop, comparable="reason IN ('anchor-quarter', 'schema-bundled', 'schema-compatible')")
    s.more(aligned=f"CASE WHEN reason = 'anchor-quarter' THEN o_raw WHEN comparable THEN {_desc(_keep('all_', '$.value > 0.02 AND NOT list_contains(gone, $.member)'))} ELSE {_EMPTY} END")
    s.drop("a", "o", "an", "on_", "miss", "extra", "common", "had", "want", "n_o", "got", "bundle", "all_", "like_", "gone")


def _phases(s: _Sql) -> str:
    """The table of company, q_ord, phase, anchor."""
    start = s.last
    rel = s.add(f"SELECT * FROM (SELECT *, {_members(_comparable('raw'))} AS segments FROM {start}) WHERE revenue > 0.02 AND NOT whole_only AND NOT partial_ AND len(segments) >= 2")
    rel = s.add(f"SELECT *, len(segments) * 20 + score + coalesce(coverage, 0) * 12 + revenue * 0.01 AS points, row_number() {_O} AS i FROM {rel}")
    s.add(f"""SELECT o.company, o.q_ord AS o_q, o.raw AS o_raw, o.revenue AS o_revenue, o.style AS o_style, a.q_ord AS a_q, a.raw AS a_raw, a.revenue AS a_revenue, a.style AS a_style, o.segments AS os, a.segments AS as_
        FROM {rel} o JOIN {rel} a ON o.company = a.company AND o.q_ord <> a.q_ord AND o.segments <> a.segments""")
    _align(s)
    common = f"len({_both('os', 'as_')})"
    s.more(many="len(os) >= 3 AND len(as_) >= 3", unlike=f"{common} / (len(os) + len(as_) - {common}) < 0.75")
    parted = s.add(f"SELECT company, greatest(o_q, a_q) AS q_ord, least(o_q, a_q) AS anchor, (bool_or(many) AND (bool_or(reason = 'schema-bundled') OR bool_or(unlike))) OR NOT bool_or(comparable) AS parted FROM {s.last} GROUP BY 1, 2, 3")
    walk = f"w{len(s.ctes)}"
    new = f"EXISTS (SELECT 1 FROM {parted} p WHERE p.company = r.company AND p.q_ord = r.q_ord AND p.anchor = w.anchor AND p.parted)"
    s.add(f"""SELECT company, i, q_ord, 0 AS phase, q_ord AS anchor, points AS best FROM {rel} WHERE i = 1
        UNION ALL SELECT company, i, q_ord, phase + CASE WHEN new THEN 1 ELSE 0 END, CASE WHEN new OR points >= best THEN q_ord ELSE anchor END, CASE WHEN new OR points >= best THEN points ELSE best END
        FROM (SELECT r.company, r.i, r.q_ord, r.points, w.phase, w.anchor, w.best, {new} AS new FROM {walk} w JOIN {rel} r ON r.company = w.company AND r.i = w.i + 1)""", walk, recursive=True)
    out = s.add(f"SELECT company, q_ord, CAST(phase AS INTEGER) AS phase, arg_max(anchor, q_ord) OVER (PARTITION BY company, phase) AS anchor FROM {walk}")
    s.last = start
    return out


def _with_phases(s: _Sql) -> None:
    start = s.last
    found = _phases(s)
    s.add(f"""SELECT q.* EXCLUDE (phase), f.phase, q.q_ord AS o_q, q.raw AS o_raw, q.revenue AS o_revenue, q.style AS o_style, a.q_ord AS a_q, a.raw AS a_raw, a.revenue AS a_revenue, a.style AS a_style
        FROM {start} q LEFT JOIN {found} f ON f.company = q.company AND f.q_ord = q.q_ord LEFT JOIN {start} a ON a.company = q.company AND a.q_ord = f.anchor""")
    _align(s)
    _fit(s, "aligned", _LEAST)
    notes = f"CASE WHEN reason = 'anchor-quarter' THEN CASE WHEN fit_note = 'none' THEN {_NO_NOTES} ELSE [fit_note] END ELSE {_noted('reason')} END"
    s.set("a_q IS NOT NULL AND comparable AND len(raw) > 0", raw="aligned", rows_="fit_rows", coverage="fit_coverage", partial_="fit_partial", notes=notes)
    s.add(f"SELECT * REPLACE (coalesce(phase, CASE WHEN lag(phase) {_O} = lead(phase) {_O} THEN lag(phase) {_O} END) AS phase) FROM {s.last}")
    s.state()


def _beside(s: _Sql, names_of, *columns: str) -> None:
    cells = {f"{side}_{c}": f"{f}({c}) {_O}" for c in ("rows_", *columns) for side, f in (("before", "lag"), ("after", "lead"))}
    s.more(**cells)
    s.more(have=names_of("rows_"), had=names_of("before_rows_"), will=names_of("after_rows_"))


def _turns(s: _Sql, fits: str) -> None:
    s.more(fits_=f"coalesce({fits}, false)", at_=f"row_number() {_O}")
    s.more(turn=f"fits_ AND (at_ - coalesce(max(CASE WHEN NOT fits_ THEN at_ END) {_O}, 0)) % 2 = 1")


def _blended(members: str) -> str:
    x = f"x{next(_names)}"
    return f"list_transform({members}, lambda {x}: {_row(x, f'({_share("before_rows_", x)} + {_share("after_rows_", x)}) / 2')})"


def _made(s: _Sql, weights: str, where: str) -> None:
    s.more(used=f"CASE WHEN {where} THEN {_keep(weights, '$.value > 0')} END")
    s.more(sum_=_total("used"))
    s.more(values_=f"CASE WHEN revenue > 0.02 AND sum_ > 0.000001 THEN {_map('used', _row('$.member', _r3('revenue * ($.value / sum_)')))} END")
    s.more(left_=_r3(f"revenue - {_total('values_')}"))
    s.more(made=_desc(_first_takes("values_", "left_")))
    s.drop("used", "sum_", "values_", "left_")


def _completed(s: _Sql) -> None:
    s.more(rest=_amount("rows_", "'otherrevenue'"), weights=_blended("missing"), spare=f"greatest(revenue - {_total(_keep('rows_', f'$.member NOT IN {_SPECIAL}'))}, 0)")
    s.more(gap="CASE WHEN rest > 0.02 THEN rest ELSE spare END", sum_=_total("weights"))
    s.more(extra=_keep(_map("weights", _row("$.member", _r3("gap * $.value / nullif(sum_, 0)"))), "$.value > 0.02"))
    s.more(got=_total("extra"))
    s.more(left_=_r3("gap - got"))
    whole = f"list_concat(list_concat({_keep('rows_', '$.member <> ' + repr('otherrevenue'))}, extra), CASE WHEN left_ > 0.03 THEN [{_row(repr('otherrevenue'), 'left_')}] ELSE {_EMPTY} END)"
    s.more(completed=f"CASE WHEN gap > 0.12 AND sum_ > 0.000001 AND got > 0.02 THEN {_desc(_keep(whole, '$.value > 0.02'))} END")
    s.drop("rest", "weights", "spare", "gap", "sum_", "extra", "got", "left_")


_STYLED = "style IS NOT NULL AND before_style IS NOT NULL AND after_style IS NOT NULL AND revenue > 0.02"
_BEFORE = {"sch": "before_sch", "fam": "before_fam"}
_NEXT_TO = "least(revenue, before_revenue, after_revenue) > 0.02 AND before_revenue IS NOT NULL AND after_revenue IS NOT NULL AND len(before_rows_) >= 2 AND len(after_rows_) >= 2 AND len(had) > 0 AND had = will AND had <> have"


def _stable_gaps(s: _Sql) -> None:
    _beside(s, _stable, "style")
    s.more(missing=_except("had", "have"))
    _completed(s)
    _turns(s, f"{_STYLED} AND len(have) > 0 AND had = will AND len({_except('have', 'had')}) = 0 AND len(missing) BETWEEN 1 AND 2 AND completed IS NOT NULL")
    s.set("turn", rows_="completed", filled="true", notes=_noted("'stable-key-gap-filled'"))
    s.state()


def _neighbour_schemas(s: _Sql) -> None:
    _beside(s, _members, "style", "sch", "fam")
    x = f"x{next(_names)}"
    s.more(top=f"coalesce(list_max(list_transform(rows_, lambda {x}: {_share('rows_', f'{x}.member')})), 0)")
    sound = "len(rows_) >= 2 AND top < 0.82 AND coalesce(coverage, 1) BETWEEN 0.7 AND 1.28"
    lacks = "len(rows_) < 2 OR whole_only OR partial_ OR list_contains(notes, 'coverage-too-low')"
    _made(s, _blended("had"), f"{_STYLED} AND len(before_rows_) >= 2 AND len(after_rows_) >= 2 AND had = will AND CASE WHEN had <> have THEN NOT ({sound}) ELSE {lacks} END")
    _turns(s, "len(made) > 0")
    s.set("turn", rows_="made", filled="true", smoothed="true", **_BEFORE, notes=_noted("'neighbor-schema-harmonized'"))
    s.state()


def _in_order(s: _Sql, rows: str) -> None:
    """rows_ become rows(prev: those of the quarter before by then; q: the quarter)."""
    start = s.more(i=f"row_number() {_O}")
    walk = f"w{len(s.ctes)}"
    s.add(f"SELECT company, i, rows_ AS new_rows FROM {start} WHERE i = 1 UNION ALL SELECT q.company, q.i, {rows} FROM (SELECT company, i, new_rows AS prev FROM {walk}) w JOIN {start} q ON q.company = w.company AND q.i = w.i + 1", walk, recursive=True)
    s.add(f"SELECT q.* EXCLUDE (i) REPLACE (w.new_rows AS rows_) FROM {start} q JOIN {walk} w USING (company, i)")


def _absorbed(s: _Sql) -> None:
    _beside(s, _stable)
    s.more(rest=_amount("rows_", "'otherrevenue'"), sound=f"source IN ('official-segments', 'structure-history') AND coalesce(coverage, 0) >= 0.85 AND len({_keep('raw', '$.member <> ' + repr('reportedrevenue'))}) >= 2")
    s.more(turn="coalesce(revenue > 0.02 AND source <> 'official-groups' AND NOT sound AND len(have) > 0 AND had = have AND have = will AND rest / greatest(revenue, 0.001) > 0.01 AND rest / greatest(revenue, 0.001) <= 0.1, false)")
    own = _keep("q.rows_", "$.member <> 'otherrevenue'")
    weight = lambda m: f"(({_share('w.prev', m)}) + ({_share('q.after_rows_', m)})) / 2"
    x, y = f"x{next(_names)}", f"y{next(_names)}"
    whole = f"nullif(list_sum(list_transform({own}, lambda {x}: {weight(f'{x}.member')})), 0)"
    spread = f"list_transform({own}, lambda {y}: {_row(f'{y}.member', _r3(f'{y}.value + coalesce(q.rest * ({weight(f"{y}.member")}) / {whole}, 0)'))})"
    _in_order(s, f"CASE WHEN q.turn THEN {_desc(_keep(spread, '$.value > 0.02'))} ELSE q.rows_ END")
    s.set("turn", smoothed="true", notes=_noted("'residual-absorbed'"))
    s.state()


def _sandwich_segments(s: _Sql) -> None:
    _beside(s, _stable, "revenue", "source", "sch", "fam")
    mean = "((before_revenue + after_revenue) / 2)"
    s.more(missing=_except("had", "have"), fits=f"coalesce({_NEXT_TO} AND source = 'official-segments' AND before_source <> 'fallback-reported' AND after_source <> 'fallback-reported' AND coalesce(coverage, 1) BETWEEN 0.72 AND 1.6 AND revenue / {mean} BETWEEN 0.45 AND 1.85, false)")
    _completed(s)
    s.add(f"SELECT * REPLACE (CASE WHEN fits AND len(missing) > 0 AND len({_except('have', 'had')}) = 0 THEN completed END AS completed) FROM {s.last}")
    _made(s, _blended("had"), "fits")
    _turns(s, "fits AND (completed IS NOT NULL OR len(made) > 0)")
    s.set("turn AND completed IS NULL", rows_="made", filled="true", smoothed="true", **_BEFORE, notes=_noted("'strict-sandwich-harmonized'"))
    s.set("turn AND completed IS NOT NULL", rows_="completed", filled="true", notes=_noted("'strict-sandwich-gap-filled'"))
    s.state()


def _sandwich_groups(s: _Sql) -> None:
    _beside(s, _stable, "revenue", "sch", "fam", "q_ord", "raw", "style")
    s.more(fits=f"coalesce({_NEXT_TO} AND source = 'official-groups' AND coalesce(coverage, 1) BETWEEN 0.95 AND 1.05, false)", h_="had")
    s.add(f"SELECT * EXCLUDE (had), q_ord AS o_q, raw AS o_raw, revenue AS o_revenue, style AS o_style, before_q_ord AS a_q, before_raw AS a_raw, before_revenue AS a_revenue, before_style AS a_style FROM {s.last}")
    _align(s)
    _fit(s, "aligned", "0.62")
    _turns(s, f"fits AND comparable AND {_stable('aligned')} = h_")
    s.set("turn", rows_="fit_rows", filled="true", **_BEFORE, notes=_noted("'strict-official-groups-aligned'"))
    s.state()


def _rebalanced(s: _Sql) -> None:
    _beside(s, _members, "revenue")
    x = f"x{next(_names)}"
    s.more(own_shares=f"list_transform(rows_, lambda {x}: {_row(f'{x}.member', _share('rows_', f'{x}.member'))})", rest=f"{_amount('rows_', repr('otherrevenue'))} / greatest(revenue, 0.001)", mean="(before_revenue + after_revenue) / 2")
    trusted = "given AND NOT whole_only AND NOT partial_ AND NOT filled AND NOT imputed AND source NOT IN ('fallback-reported', 'none') AND coalesce(coverage, 1) BETWEEN 0.94 AND 1.12 AND rest <= 0.05"
    s.more(turn=f"coalesce(least(len(rows_), len(before_rows_), len(after_rows_)) >= 2 AND before_rows_ IS NOT NULL AND after_rows_ IS NOT NULL AND revenue > 0.02 AND had = have AND have = will AND NOT ({trusted}) AND list_max({_map('own_shares', '$.value')}) > 0.68 AND (mean <= 0.02 OR revenue / mean < 1.3) AND NOT smoothed, false)", given_rows="rows_")
    expected = lambda m: f"((({_share('w.prev', m)}) + ({_share('q.after_rows_', m)})) / 2)"
    x, y = f"x{next(_names)}", f"y{next(_names)}"
    off = f"list_max(list_transform(q.own_shares, lambda {x}: abs({x}.value - {expected(f'{x}.member')})))"
    values = f"list_transform(q.rows_, lambda {y}: {_row(f'{y}.member', _r3(f'q.revenue * least({expected(f"{y}.member")}, 1)'))})"
    _in_order(s, f"CASE WHEN q.turn AND {off} > 0.3 THEN {_desc(_first_takes(values, _r3(f'q.revenue - {_total(values)}')))} ELSE q.rows_ END")
    s.set("rows_ <> given_rows", smoothed="true", notes=_noted("'neighbor-share-rebalanced'"))
    s.state()


def _sandwich(s: _Sql) -> None:
    _sandwich_segments(s)
    _sandwich_groups(s)
    _rebalanced(s)


def _single_gaps(s: _Sql) -> None:
    s.more(single="max(CASE WHEN len(rows_) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY company) > 0 AND len(rows_) = 1 AND revenue > 0.02 AND given AND NOT whole_only")
    s.set("single", partial_="true", notes="CASE WHEN len(notes) = 0 THEN ['single-segment-gap'] ELSE notes END")
    s.state()


def _pooled(s: _Sql) -> str:
    """The state with spot, was (the phase then; -1: not reliable, -2: in none), main and n_main."""
    s.more(many="max(CASE WHEN len(rows_) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY company) > 0", spot=f"row_number() {_O}")
    s.more(was="CASE WHEN given AND NOT whole_only AND NOT partial_ AND len(rows_) >= CASE WHEN many THEN 2 ELSE 1 END AND (style IS NOT NULL OR (source <> 'fallback-reported' AND coalesce(coverage, 0) BETWEEN 0.78 AND 1.22)) THEN coalesce(phase, -2) ELSE -1 END")
    start = s.drop("many")
    mains = s.add(f"SELECT company, was AS main, n AS n_main FROM (SELECT company, was, count(*) AS n FROM {start} WHERE was >= 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, was) = 1")
    return s.add(f"SELECT s.*, m.main, coalesce(m.n_main, 0) AS n_main FROM {start} s LEFT JOIN {mains} m USING (company)")


def _from_template(s: _Sql, where: str) -> None:
    """made: of the table's template (a place) and of_phase (whose reliable quarters count outside it); pool is the reliable part of the table."""
    start = s.last
    pool = s.add(f"SELECT company, spot AS p_at, was AS p_was, rows_ AS p_rows FROM {start} WHERE was <> -1")
    phase = s.add(f"SELECT company, p_was, list({{spot: p_at, r: p_rows}} ORDER BY p_at) AS members FROM {pool} WHERE p_was >= 0 GROUP BY 1, 2")
    s.add(f"SELECT q.*, t.p_rows AS t_rows, coalesce(f.members, CASE WHEN t.p_at IS NOT NULL THEN [{{spot: t.p_at, r: t.p_rows}}] END) AS members FROM {start} q LEFT JOIN {pool} t ON t.company = q.company AND t.p_at = q.template LEFT JOIN {phase} f ON f.company = q.company AND f.p_was = q.of_phase")
    s.more(side=f"CASE WHEN spot < members[1].spot THEN members[1:3] WHEN spot > members[-1].spot THEN members[greatest(len(members) - 2, 1):len(members)] END")
    s.more(near=_keep(_map("side", "$.r"), "len($) >= 2"))
    s.add(f"SELECT * REPLACE (CASE WHEN len(near) > 0 THEN near WHEN t_rows IS NOT NULL THEN [t_rows] END AS near) FROM {s.last}")
    s.more(all_="flatten(list_transform(near, lambda r: list_transform(r, lambda c: c.member)))")
    s.more(order_="list_filter(all_, lambda m, i: list_position(all_, m) = i)")
    m, r = f"m{next(_names)}", f"r{next(_names)}"
    mean = f"list_transform(order_, lambda {m}: {_row(m, f'list_sum(list_transform(near, lambda {r}: {_share(r, m)})) / len(near)')})"
    _made(s, mean, f"({where}) AND len(near) > 0")


def _template_fill(s: _Sql) -> None:
    start = s.more(coarse=_COARSE, needs=f"revenue > 0.02 AND (len(rows_) < 2 OR whole_only OR partial_)")
    tier = "CASE WHEN q.style IS NULL AND q.n_main >= 6 AND q.coarse AND p.was = q.main THEN 0 WHEN p.sch = q.sch THEN 1 WHEN p.was = q.phase THEN 2 WHEN p.fam = q.fam AND (q.phase IS NULL OR p.was = q.phase) THEN 3 WHEN p.spot < q.spot THEN 4 ELSE 5 END"
    chosen = s.add(f"""SELECT q.company, q.spot, p.spot AS template, p.sch AS t_sch, p.fam AS t_fam, CASE WHEN p.was >= 0 THEN p.was END AS of_phase FROM {start} q JOIN {start} p ON p.company = q.company AND p.was <> -1
        QUALIFY row_number() OVER (PARTITION BY q.company, q.spot ORDER BY {tier}, abs(p.spot - q.spot), p.spot) = 1""")
    s.add(f"SELECT q.*, c.template, c.t_sch, c.t_fam, c.of_phase FROM {start} q LEFT JOIN {chosen} c USING (company, spot)")
    _from_template(s, "needs AND (style IS NOT NULL OR (of_phase = main AND n_main >= 6 AND coarse)) AND abs(template - spot) <= CASE WHEN style IS NULL THEN 16 ELSE 4 END")
    s.set("len(made) > 0", rows_="made", filled="true", imputed="style IS NULL", phase="coalesce(phase, of_phase)", sch="t_sch", fam="t_fam", notes=_noted("'template-harmonized'"))
    s.add(f"SELECT company, q_ord, {', '.join(_STATE)}, spot, was, main, n_main FROM {s.last}")


def _late_fill(s: _Sql) -> None:
    start = s.last
    chosen = s.add(f"SELECT q.company, q.spot, p.spot AS template, p.phase AS of_phase FROM {start} q JOIN {start} p ON p.company = q.company AND p.was = q.main QUALIFY row_number() OVER (PARTITION BY q.company, q.spot ORDER BY abs(p.spot - q.spot), p.spot) = 1")
    s.add(f"SELECT q.*, c.template, c.of_phase, count(*) FILTER (was <> -1) OVER (PARTITION BY company) AS n_pool FROM {start} q LEFT JOIN {chosen} c USING (company, spot)")
    _from_template(s, "template IS NOT NULL AND revenue > 0.02 AND len(rows_) = 1 AND rows_[1].member = 'reportedrevenue' AND n_main >= 6 AND n_main / n_pool >= 0.75")
    s.set("len(made) > 0", rows_="made", filled="true", imputed="true", phase="coalesce(phase, main)", notes=_noted("'template-harmonized'"))
    s.state()


def _repaired(s: _Sql) -> None:
    _with_phases(s)
    _single_gaps(s)
    pool = _pooled(s)
    beside = lambda: s.add(f"SELECT s.*, p.spot, p.was, p.main, p.n_main FROM {s.last} s JOIN {pool} p USING (company, q_ord)")
    s.state()
    _stable_gaps(s)
    _neighbour_schemas(s)
    beside()
    _template_fill(s)
    s.state()
    s.set("filled AND len(rows_) > 0 AND (whole_only OR partial_)", raw="rows_", coverage="1", partial_="false", whole_only="false", given="true")
    _with_phases(s)
    weak = f"revenue > 0.02 AND style IS NULL AND source = 'official-segments' AND coalesce(coverage, 0) < 0.72 AND {_amount('rows_', repr('otherrevenue'))} / greatest(revenue, 0.001) > 0.28"
    s.more(weak=weak)
    s.set("revenue > 0.02 AND NOT weak", rows_=_keep("rows_", f"NOT ($.member IN {_SPECIAL} AND $.value / greatest(revenue, 0.001) < 0.015)"))
    s.set("weak", rows_=_EMPTY, given="false", partial_="true", notes=_noted("'residual-dominant'"))
    _absorbed(s)
    s.set("len(rows_) = 0 AND revenue > 0.02", rows_=f"[{_row(repr('reportedrevenue'), 'revenue')}]", notes="CASE WHEN len(notes) = 0 THEN ['fallback-single-segment'] ELSE notes END")
    beside()
    _late_fill(s)
    _sandwich(s)


_CELLS = "company, q_ord, phase, filled, imputed, smoothed, partial_ AS partial, array_to_string(notes, '+') AS notes, r.member, r.value FROM $ LEFT JOIN LATERAL (SELECT unnest(rows_) AS r) u ON true"


def _of(*steps) -> str:
    s = _base()
    for step in steps:
        step(s)
    return s.select(_CELLS)


def _pairs(s: _Sql) -> None:
    s.add(f"SELECT company, q_ord AS o_q, raw AS o_raw, revenue AS o_revenue, style AS o_style, lag(q_ord) {_O} AS a_q, lag(raw) {_O} AS a_raw, lag(revenue) {_O} AS a_revenue, lag(style) {_O} AS a_style FROM {s.last}")
    s.add(f"SELECT * FROM {s.last} WHERE a_q IS NOT NULL")
    _align(s)


def _aligned_sql() -> str:
    s = _base()
    _pairs(s)
    return s.select("company, o_q AS q_ord, comparable, reason, r.member, r.value FROM $ LEFT JOIN LATERAL (SELECT unnest(aligned) AS r) u ON true")


def _phases_sql() -> str:
    s = _base()
    s.last = _phases(s)
    return s.select("company, q_ord, phase, anchor FROM $")


def _history_sql() -> str:
    s = _base()
    _repaired(s)
    cells = s.add(f"SELECT company, q_ord, revenue, unnest(rows_, recursive := true) FROM (SELECT * FROM {s.last} QUALIFY row_number() OVER (PARTITION BY company ORDER BY q_ord DESC) <= 24)")
    place = f"row_number() OVER (PARTITION BY company ORDER BY {_r3('sum(value)')} DESC, member)"
    sums = s.add(f"SELECT company, member, {place} AS place, count(*) OVER (PARTITION BY company) AS n FROM {cells} GROUP BY company, member")
    s.add(f"SELECT company, q_ord, revenue, CASE WHEN n <= 6 OR place < 6 THEN member ELSE '__other_segments__' END AS member, value FROM {cells} JOIN {sums} USING (company, member)")
    joined = s.add(f"SELECT * FROM (SELECT company, q_ord, revenue, member, {_r3('sum(value)')} AS value, sum(value) AS whole FROM {s.last} GROUP BY 1, 2, 3, 4) WHERE member <> '__other_segments__' OR value > 0.02")
    ranks = s.add(f"SELECT company, member, {place} AS rank FROM {joined} GROUP BY company, member")
    return s.select(f"j.company, j.q_ord, j.revenue, j.member, j.value, r.rank FROM {joined} j JOIN {ranks} r USING (company, member)")


def _groups_sql() -> str:
    s = _base()
    _repaired(s)
    s.more(own=_keep("rows_", "$.member <> 'reportedrevenue' AND $.value > 0.02"))
    s.add(f"SELECT company, q_ord, unnest(own, recursive := true) FROM {s.last} WHERE len(own) >= 2")
    return s.select(f"company, q_ord, member, {_r3('value / greatest(scale, 0.000001)')} AS value FROM $ JOIN sources USING (company, q_ord)")


ORACLE_SQL = {
    "reconciled_quarters": _of(),
    "aligned_quarters": _aligned_sql(),
    "bundle_phases": _phases_sql(),
    "phase_alignment": _of(_with_phases),
    "template_fills": _of(_single_gaps, _pooled, _template_fill),
    "sandwich_repairs": _of(_sandwich),
    "revenue_history": _history_sql(),
    "business_groups": _groups_sql(),
}

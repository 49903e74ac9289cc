"""Literal cases of revenue histories, flows, costs and statements in lines."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import composition, flows, history
from tallyloom.operators import revenue_history as rh
from tallyloom.sources import statement_lines as sl

SOURCES = "company long, q_ord long, revenue double, style string, source string, score double, scale double, segments array<struct<member:string,value:double>>"
WHOLE = {"reportedrevenue": 100}
A = {"x": 50, "y": 30, "z": 20}


def _quarters(spark, *quarters, style=None, source="official-segments", revenue=100):
    """One company's quarters from dicts of members, or (members, changed fields)."""
    rows = []
    for i, quarter in enumerate(quarters):
        members, more = quarter if isinstance(quarter, tuple) else (quarter, {})
        own = {"revenue": revenue, "style": style, "source": "fallback-reported" if members == WHOLE else source, "scale": 1.0, **more}
        rows.append((1, i, None if own["revenue"] is None else float(own["revenue"]), own["style"], own["source"], 60.0, own["scale"], [(m, float(v)) for m, v in members.items()]))
    return rh.quarter_rows(spark.createDataFrame(rows, SOURCES))


def _rows(df):
    return {r.q_ord: {c.member: c.value for c in r.rows} for r in df.collect()}


def _notes(df):
    return {r.q_ord: r.notes for r in df.collect()}


# ---------------------------------------------------------------- quarters and anchors


def test_quarters_are_scaled_and_reconciled(spark):
    told = _quarters(spark, ({"x": 10, "y": 5}, {"scale": 2.0, "revenue": 20}), ({"x": 30}, {"revenue": 100}), ({"x": 80, "y": 60}, {"revenue": 100}), ({"x": 3}, {"revenue": None}), ({}, {"revenue": None}), WHOLE)
    got = {r.q_ord: (r.revenue, {c.member: c.value for c in r.rows}, r.partial, r.whole_only, r.notes) for r in told.collect()}
    assert got[0] == (40.0, {"x": 20.0, "y": 10.0, "otherrevenue": 10.0}, False, False, ["residual-added"])
    assert got[1] == (100.0, {}, True, False, ["coverage-too-low"])
    assert got[2] == (100.0, {"x": 57.143, "y": 42.857}, False, False, ["scaled-down"])
    assert got[3] == (3.0, {"x": 3.0}, False, False, [])
    assert got[5] == (100.0, {"reportedrevenue": 100.0}, False, True, []) and 4 not in got


def _align(spark, own, anchor, **more):
    slim = F.struct("q_ord", "raw", "revenue", "style")
    q = _quarters(spark, own, anchor, **more)
    pair = q.filter("q_ord = 0").select("company", slim.alias("own")).join(q.filter("q_ord = 1").select("company", slim.alias("anchor")), "company")
    r = rh.aligned(pair).first()
    return r.reason, {c.member: c.value for c in r.aligned}


@pytest.mark.parametrize(
    ("own", "anchor", "want"),
    [
        ({"x": 48, "y": 32, "v": 12, "w": 8}, A, ("schema-bundled", {"x": 48.0, "y": 32.0, "z": 20.0})),  # two for the one that is missing
        ({"x": 48, "y": 46, "w": 6}, A | {"z": 20}, ("schema-bundled", {"x": 48.0, "y": 46.0, "z": 6.0})),  # within 0.18
        ({"x": 50, "y": 30, "z": 14, "w": 6}, A, ("schema-compatible", {"x": 50.0, "y": 30.0, "z": 14.0})),  # an extra of 0.08 at most goes
        ({"x": 40, "y": 30, "z": 14, "w": 16}, A, ("schema-compatible", {"x": 40.0, "y": 30.0, "z": 14.0, "w": 16.0})),
        ({"a": 60, "b": 40}, A, ("schema-mismatch", {})),
        ({"x": 100}, {"x": 100}, ("insufficient-profile", {})),
        (({"x": 50, "y": 50}, {"style": "s"}), (A, {"style": "t"}), ("style-mismatch", {})),
        (({"x": 20, "y": 15, "a": 25, "b": 20, "c": 20}, {"style": "s"}), (A, {"style": "s"}), ("schema-compatible", {"x": 20.0, "y": 15.0, "a": 25.0, "b": 20.0, "c": 20.0})),  # one style: 0.45 of the anchor
        ({"x": 20, "y": 15, "a": 25, "b": 20, "c": 20}, A, ("schema-mismatch", {})),
    ],
)
def test_alignment(spark, own, anchor, want):
    assert _align(spark, own, anchor) == want


def test_phases_and_anchors(spark):
    """A bundle of three or more parts phases; the anchor moves on while scores don't fall; a whole between two of a phase joins it."""
    told = _quarters(spark, A, A, {"x": 50, "y": 30, "w": 20}, A, A, WHOLE, A | {"x": 40, "q": 10})
    got = {r.q_ord: (r.phase, r.anchor) for r in rh.phases(told).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (1, 2), 3: (2, 6), 4: (2, 6), 6: (2, 6)}
    assert {r.q_ord: r.phase for r in rh.with_phases(told).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2}


def test_phases_compare_a_quarter_with_one_anchor(spark):
    """Quarters of a company aren't joined with each other: in the order of quarters each meets the anchor of its time."""
    quarters = _quarters(spark, A, {"x": 30, "y": 50, "z": 20}, {"p": 50, "q": 30, "r": 20}, WHOLE, {"p": 45, "q": 35, "r": 20}, A)
    told = rh.phases(quarters)
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[1:] for r in told.orderBy("q_ord").collect()] == [(0, 0, 1), (1, 0, 1), (2, 1, 4), (4, 1, 4), (5, 2, 5)]


def test_with_phases_joins_each_quarter_once(spark):
    """A quarter meets its phase and its phase's anchor: two joins, neither of all pairs of a company's quarters."""
    quarters = _quarters(spark, A, {"x": 48, "y": 32, "v": 12, "w": 8}, A)
    told = rh.with_phases(quarters)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2 and "Join Inner" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert {q: sum(r.values()) for q, r in _rows(told).items()} == {0: 100.0, 1: 100.0, 2: 100.0}


# ---------------------------------------------------------------- repairs


def test_sandwich_of_segments(spark):
    told = rh.sandwich_segments(_quarters(spark, A, {"x": 50, "y": 30}, A, {"x": 48, "y": 32, "w": 20}, A, ({"x": 70, "y": 30}, {"source": "official-groups"}), A))
    assert _rows(told)[1] == {"x": 50.0, "y": 30.0, "z": 20.0} and _notes(told)[1] == ["residual-added", "strict-sandwich-gap-filled"]
    assert _rows(told)[3] == {"x": 50.0, "y": 30.0, "z": 20.0} and _notes(told)[3] == ["strict-sandwich-harmonized"]
    assert _rows(told)[5] == {"x": 70.0, "y": 30.0}  # groups have a repair of their own


def test_every_other_of_alternating_quarters_is_repaired(spark):
    b = {"x": 50, "w": 50}
    told = _rows(rh.sandwich_segments(_quarters(spark, A, b, A, b, A, b)))
    assert [sorted(told[i]) for i in range(6)] == [["x", "y", "z"], ["x", "y", "z"], ["x", "y", "z"], ["x", "y", "z"], ["x", "y", "z"], ["w", "x"]]


def test_sandwich_keeps_jumps_of_revenue(spark):
    told = rh.sandwich_segments(_quarters(spark, A, ({"x": 150, "w": 50}, {"revenue": 200}), A))
    assert _rows(told)[1] == {"x": 150.0, "w": 50.0}


def test_sandwich_of_groups(spark):
    told = rh.sandwich_groups(_quarters(spark, A, {"x": 48, "y": 32, "v": 12, "w": 8}, A, source="official-groups"))
    assert _rows(told)[1] == {"x": 48.0, "y": 32.0, "z": 20.0} and _notes(told)[1] == ["strict-official-groups-aligned"]


def test_rebalance_goes_on_from_quarter_to_quarter(spark):
    """Two quarters off in a row: the second one's earlier neighbour is rebalanced by then."""
    off = ({"x": 10, "y": 5, "z": 85}, {"source": "none"})
    told = _rows(rh.rebalanced(_quarters(spark, A, off, A, off, A)))
    assert told[1] == told[3] == {"x": 50.0, "y": 30.0, "z": 20.0}
    trusted = _rows(rh.rebalanced(_quarters(spark, A, {"x": 10, "y": 5, "z": 85}, A)))
    assert trusted[1] == {"z": 85.0, "x": 10.0, "y": 5.0}


def test_rests_are_absorbed(spark):
    part = ({"x": 47, "y": 27, "z": 18}, {"source": "other"})
    told = rh.absorbed_rests(_quarters(spark, A, part, A))
    assert _rows(told)[1] == {"x": 51.0, "y": 29.4, "z": 19.6} and _notes(told)[1] == ["residual-added", "residual-absorbed"]


def test_gaps_within_a_style(spark):
    told = rh.stable_gaps(_quarters(spark, A, {"x": 50, "y": 30}, A, style="s"))
    assert _rows(told)[1] == {"x": 50.0, "y": 30.0, "z": 20.0}
    alone = rh.neighbour_schemas(_quarters(spark, A, WHOLE, A, style="s"))
    assert _rows(alone)[1] == {"x": 50.0, "y": 30.0, "z": 20.0} and alone.filter("q_ord = 1").first().smoothed


def _templates(spark, *quarters, **more):
    return rh.template_fill(rh.pooled(rh.with_phases(_quarters(spark, *quarters, **more))))


def test_templates_of_the_main_phase(spark):
    """Six quarters or more: a whole takes the nearest one's shares, beyond the phase the mean of its three last."""
    later = [{"x": 60, "y": 20, "z": 20}, {"x": 60, "y": 25, "z": 15}, {"x": 60, "y": 30, "z": 10}]
    told = _templates(spark, *[A] * 2, WHOLE, *[A] * 2, *later, ({"reportedrevenue": 200}, {"revenue": 200, "source": "fallback-reported"}))
    assert _rows(told)[2] == {"x": 50.0, "y": 30.0, "z": 20.0}
    assert _rows(told)[8] == {"x": 120.0, "y": 50.0, "z": 30.0}
    assert [r.imputed for r in told.orderBy("q_ord").collect()] == [False, False, True, False, False, False, False, False, True]


def test_templates_need_six_quarters_or_a_style(spark):
    assert _rows(_templates(spark, A, A, WHOLE, A, A))[2] == {"reportedrevenue": 100.0}
    styled = _templates(spark, A, *[WHOLE] * 5, style="s")
    assert [sorted(_rows(styled)[i]) for i in (4, 5)] == [["x", "y", "z"], ["reportedrevenue"]]  # four places away, not five


def test_weak_rests_go_and_wholes_come_back(spark):
    told = rh.whole_if_none(rh.without_weak_rows(_quarters(spark, {"x": 40, "y": 25}, {"x": 60, "y": 38.9, "otherrevenue": 1.1}, {"x": 20})))
    assert _rows(told) == {0: {"reportedrevenue": 100.0}, 1: {"x": 60.0, "y": 38.9}, 2: {"reportedrevenue": 100.0}}
    assert _notes(told)[0] == ["residual-added", "residual-dominant"]


def test_history_joins_small_members(spark):
    many = {f"m{i:02d}": 100 - i for i in range(12)}
    told = rh.history(_quarters(spark, *[many] * 3, revenue=sum(many.values())), n_quarters=2).collect()
    assert {r.q_ord for r in told} == {1, 2}
    last = {r.member: (r.value, r.rank) for r in told if r.q_ord == 2}
    assert len(last) == 9 and last["__other_segments__"] == (sum(100.0 - i for i in range(8, 12)), 1) and last["m00"] == (100.0, 2) and last["m07"] == (93.0, 9)


def test_business_groups(spark):
    sources = _quarters(spark, (A, {"scale": 0.5}), *[A] * 2, WHOLE)
    scale = spark.createDataFrame([(1, i, 0.5 if i == 0 else 1.0) for i in range(4)], "company long, q_ord long, scale double")
    got = {(r.q_ord, r.member): r.value for r in rh.business_groups(sources, scale).collect()}
    assert got[0, "x"] == 50.0 and got[1, "x"] == 50.0 and not any(q == 3 for q, _ in got)


def test_no_quarters(spark):
    none = rh.quarter_rows(spark.createDataFrame([], SOURCES))
    assert rh.history(none).count() == 0


# ---------------------------------------------------------------- flows and costs

STAGES = "company long, q_ord long, revenue double, cost double, gross double, opex double, op_income double, sgna double, rnd double, opex_sum double, pretax double, net double, tax double, non_op double"


def _snapshot(spark, **v):
    names = [c.split()[0] for c in STAGES.split(", ")][2:]
    return flows.snapshot(spark.createDataFrame([(1, 1, *(float(v[n]) if n in v else None for n in names))], STAGES))


def test_full_bridge_is_conserved(spark):
    told = _snapshot(spark, revenue=100, cost=40, opex=35, op_income=25, pretax=28, net=21, tax=7, non_op=3)
    r = told.first()
    assert (r.coverage, r.gross, r.operating, r.opex, r.overflow, r.non_operating, r.pretax) == ("full", 60.0, 25.0, 35.0, 0.0, 3.0, 28.0)
    assert (r.gross_margin, r.operating_margin, r.net_margin) == (60.0, 25.0, 21.0)
    assert [tuple(x) for x in r.gains] == [("Non-operating gain", 3.0)] and [tuple(x) for x in r.losses] == [("Tax", 7.0)]
    edges = {(e.source, e.target): e.value for e in flows.bridge_flows(told).collect()}
    out = lambda n: sum(v for (s, _), v in edges.items() if s == n)
    assert edges["revenue", "gross"] + edges["revenue", "cost"] == 100.0 and out("gross") == 60.0 and out("revenue") == 100.0


def test_bridge_of_a_loss(spark):
    """Expenses beyond the gross profit overflow; a benefit and a gain of unknown cause lead to net income."""
    r = _snapshot(spark, revenue=100, cost=70, opex=45, op_income=-15, net=2, tax=-4).first()
    assert (r.operating, r.opex, r.overflow) == (-15.0, 30.0, 15.0)
    assert {x.name: x.value for x in r.losses} == {"Operating loss overflow": 15.0}
    assert {x.name: x.value for x in r.gains} == {"Other pretax gain": 13.0, "Tax benefit": 4.0}
    later = _snapshot(spark, revenue=100, cost=70, opex=45, op_income=-15, net=2, tax=-4, non_op=5, pretax=-10).first()
    assert {x.name: x.value for x in later.gains}["Tax benefit"] == 4.0


def test_bridge_of_revenue_only(spark):
    told = _snapshot(spark, revenue=50, net=5)
    r = told.first()
    assert (r.coverage, r.gross, r.operating, r.opex, r.net_margin, r.gains, r.losses) == ("revenue-only", None, None, None, 10.0, [], [])
    assert [tuple(e)[2:] for e in flows.bridge_flows(told).collect()] == [("revenue", "reported", 50.0)]


def test_costs_from_margins(spark):
    schema = "company long, q_ord long, member string, value double, margin double, cost double"
    rows = [(1, 1, "a", 60.0, 50.0, 45.0), (1, 1, "b", 40.0, None, 45.0)]  # the one without a margin takes what is left
    rows += [(1, 2, "a", 60.0, 50.0, 45.0), (1, 2, "b", 40.0, 75.0, 45.0)]  # 40 against 45: scaled
    rows += [(1, 3, "a", 60.0, 50.0, 40.3), (1, 3, "b", 40.0, 75.0, 40.3)]  # within 1.5 hundredths
    rows += [(1, 4, "a", 60.0, 50.0, 45.0), (1, 4, "b", 20.0, None, 45.0), (1, 4, "c", 20.0, None, 45.0)]  # two open ones take none
    rows += [(1, 5, "a", 60.0, 200.0, 45.0)]
    got = {(r.q_ord, r.member): r.value for r in flows.profile_costs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "a"): 30.0, (1, "b"): 15.0, (2, "a"): 33.75, (2, "b"): 11.25, (3, "a"): 30.0, (3, "b"): 10.0, (4, "a"): 30.0, (5, "a"): 45.0}


def test_profile_costs_are_the_same_in_any_order(spark):
    scaled = [("a", 0.839, 74.0), ("b", 1.461, 34.0), ("c", 1.202, 85.0), ("d", 0.554, 79.0), ("e", 1.737, 20.0), ("f", 0.988, 85.0)]  # d is 0.116 * 4.069 / 3.016 = 0.1565
    left = [("a", 1.844, 20.0), ("d", 1.083, None), ("b", 0.075, 3.0), ("c", 2.862, 17.0), ("e", 4.477, 83.0)]  # d is 6.205 - 4.6845 = 1.5205
    rows = [(1, q, *r, 4.069) for q, order in enumerate(permutations(scaled)) for r in order] + [(2, q, *r, 6.205) for q, order in enumerate(permutations(left)) for r in order]
    df = spark.createDataFrame(rows, "company long, q_ord long, member string, value double, margin double, cost double").coalesce(1)
    assert len({(r.company, r.value) for r in flows.profile_costs(df).filter("member = 'd'").collect()}) == 2


def test_cost_cascade(spark):
    quarters = spark.createDataFrame([(1, q, 50.0, 12.0, None) for q in (1, 2, 3)], "company long, q_ord long, cost double, tac double, other_cost double")
    cell = "company long, q_ord long, member string, value double"
    given = [spark.createDataFrame([(1, 1, "a", 20.0), (1, 1, "b", 20.0)], cell), spark.createDataFrame([(1, 1, "c", 50.0)], cell)]
    segments = spark.createDataFrame([(1, q, "s", 90.0, None) for q in (1, 2)], cell + ", margin double")
    got = sorted(tuple(r)[1:] for r in flows.cost_cascade(quarters, given, segments).collect())
    assert got == [(1, "given 0", "a", 20.0), (1, "given 0", "b", 20.0), (1, "given 0", "residual", 10.0), (2, "profile", "s", 50.0), (3, "funnel", "Other", 38.0), (3, "funnel", "TAC", 12.0)]


def test_given_costs_are_the_same_in_any_order(spark):
    given = [("a", 1.35), ("b", 0.269), ("c", 2.636), ("d", 0.983), ("e", 2.862)]  # a is 1.35 * 2.019 / 8.1 = 0.3365
    cells = spark.createDataFrame([(1, q, *r) for q, order in enumerate(permutations(given)) for r in order], "company long, q_ord long, member string, value double").coalesce(1)
    quarters = spark.createDataFrame([(1, q, 2.019, None, None) for q in range(120)], "company long, q_ord long, cost double, tac double, other_cost double")
    got = flows.cost_cascade(quarters, [cells], cells.withColumn("margin", F.lit(None).cast("double")))
    assert len({r.value for r in got.filter("member = 'a'").collect()}) == 1


# ---------------------------------------------------------------- lines of statements


def _lines(spark, *texts, doc=1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc long, line_i int, text string")


def test_rows_by_context(spark):
    lines = _lines(spark, "Non-GAAP reconciliation", "Revenue 1.0 2.0 3.0 4.0", *["text"] * 13, "Three months ended March 31, 2024", "Revenue 10.0 12%", "(2) Revenue (3) 20.0 21.0 22.0 23.0", "Revenue was up 7.0")
    hint = spark.createDataFrame([(1, 2024 * 4)], "doc long, q_ord long")
    told = sl.best_rows(lines, {"revenue": ["Revenue"]}, hint).first()
    assert (told.line_i, told.values, told.score) == (17, [20.0, 21.0, 22.0, 23.0], 24)
    assert sl.best_rows(lines, {"revenue": ["Revenue"]}).first().values == [1.0, 2.0, 3.0, 4.0]
    prior = sl.best_rows(_lines(spark, "March 31, 2023", "Revenue 1.0 2.0"), {"revenue": ["Revenue"]}, hint).first()
    assert prior.score == 8 + 6


def test_best_parses_of_lines(spark):
    told = sl.best_parses(_lines(spark, "Cost of revenue:", "Goods 10 20", "Income taxes", "for the year", "(5) 6%", "一、 营业收入：", "1,000"), {"cost": ["Cost of revenue"], "sales": ["营业收入"]})
    got = {r.line_i: (r.label, r.field, r.values) for r in told.collect()}
    assert got[0] == ("Cost of revenue", "cost", []) and got[1] == ("Goods", None, [10.0, 20.0])
    assert got[2] == ("Income taxes for the year", None, [-5.0, 6.0]) and got[3] == ("for the year", None, [-5.0, 6.0])
    assert got[5] == ("营业收入", "sales", [1000.0])


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["Results", "Q3 2024 Q2 2024 3Q23 Q3 2024"], [("2024Q3", 1), ("2024Q2", 1), ("2023Q3", 1)]),
        (["x | Three months ended | Nine months ended", "a | September 30, | September 30,", "b | 2024 | 2023 | 2024 | 2023"], [("2024Q3", 1), ("2023Q3", 1), ("2024Q3", 3), ("2023Q3", 3)]),
        (["x | Quarter ended | Year ended", "a | June 30 | December 31", "b | 2024 | 2023 | 2022"], [("2024Q2", 1), ("2023Q4", 4), ("2022Q4", 4)]),
        (["Six Months Ended", "June 30,", "2024 2023 2022"], [("2024Q2", 2), ("2023Q2", 2)]),
        (["截至2024年6月30日止六个月期间 截至2023年6月30日止六个月期间"], [("2024Q2", 2), ("2023Q2", 2)]),
        (["2024年4-6月 2023年4-6月 2023年4-7月"], [("2024Q2", 1), ("2023Q2", 1)]),
        (["合并利润表", "年初到报告期末"], [("2024Q3", 3), ("2023Q3", 3)]),
        (["nothing"], None),
    ],
)
def test_period_columns(spark, texts, want):
    context = sl.period_context(spark.createDataFrame([(1, "某公司2024年第三季度报告")], "doc long, text string"))
    got = sl.period_columns(_lines(spark, *texts), context).first()
    assert (got and [(f"{p.q_ord // 4}Q{p.q_ord % 4 + 1}", p.span) for p in got.columns]) == want


@pytest.mark.parametrize(("text", "want"), [("2024年半年度报告", (2024 * 4 + 1, "half-year")), ("2024年年度报告", (2024 * 4 + 3, "annual")), ("2024年 第 2 季度报告", (2024 * 4 + 1, "quarterly")), ("2024年通知", None), ("report", None)])
def test_period_context(spark, text, want):
    got = sl.period_context(spark.createDataFrame([(1, text)], "doc long, text string")).first()
    assert (got and (got.q_ord, got.kind)) == want


def test_statement_entries(spark):
    lines = _lines(spark, "Q1 2024 Q1 2023", "Revenue 5 123,456 111,111", "Cost of revenue (70,000) (60,000)", "Revenue 1 2")
    got = {(r.q_ord - 8092, r.field): r.value for r in sl.statement_entries(lines, {"cost": ["Cost of revenue"], "revenue": ["Revenue"]}).collect()}
    assert got == {(4, "revenue"): 123_456_000.0, (0, "revenue"): 111_111_000.0, (4, "cost"): 70_000_000.0, (0, "cost"): 60_000_000.0}


def test_section_rows(spark):
    parses = sl.best_parses(_lines(spark, "Costs and expenses:", "Research 5 6", "Selling 7 8", "Research 9 9", "Total costs and expenses 12 14", "Later 1 2"), {"opex": ["Costs and expenses"]})
    got = sl.section_rows(parses, ("costsandexpenses",), ("totalcostsandexpenses",), ("tax",)).orderBy("line_i").collect()
    assert [(r.label, r["values"]) for r in got] == [("Research", [5.0, 6.0]), ("Selling", [7.0, 8.0])]


def test_url_rank(spark):
    urls = ["https://x/a/presentation-q4-2024.pdf", "https://x/q2-2024-results.pdf", "https://x/q3-2024-results.htm", "https://x/q3-2024-results.pdf", "https://x/q4-2023-earnings.pdf", "https://x/other.pdf"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", sl.url_rank(F.col("u")).alias("r"))
    assert [r.u.rpartition("/")[2] for r in df.orderBy("r").collect()] == ["q3-2024-results.pdf", "q3-2024-results.htm", "q2-2024-results.pdf", "q4-2023-earnings.pdf", "other.pdf", "presentation-q4-2024.pdf"]


def test_url_rank_takes_no_file_number_for_a_year(spark):
    urls = ["https://x/earnings-q4-2016-2031.htm", "https://x/earnings-q4-2022-1587.htm", "https://x/earnings-q1-2022.pdf"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", sl.url_rank(F.col("u"), r"-\d+(?=\.(?:pdf|htm)$)").alias("r"))
    assert [r.u for r in df.filter("u NOT LIKE '%q1%'").orderBy("r").collect()] == [urls[1], urls[0]]


def test_grid_lines_keep_columns_and_order(spark):
    seen = [(1, "Revenue", 0.1, 0.9, 0.01), (1, "net", 0.13, 0.9, 0.01), (1, "100", 0.5, 0.901, 0.01), (1, "120", 0.8, 0.899, 0.01), (1, "Tax", 0.12, 0.4, 0.05), (1, "20", 0.52, 0.42, 0.05), (1, " ", 0.5, 0.4, 0.01), (2, "alone", 0.1, 0.5, 0.01), (3, None, None, None, None)]
    df = spark.createDataFrame(seen, "page long, text string, x double, y double, height double").repartition(3)
    assert [tuple(r) for r in history.grid_lines(df).orderBy("page", "line").collect()] == [(1, 0, "Revenue net | 100 | 120"), (1, 1, "Tax | 20")]


def test_grid_lines_fold_a_page_once(spark):
    """The fold over a page's items is in the plan once: neither within a lambda over the items nor in a filter of its own."""
    df = spark.createDataFrame([(1, str(i % 7), 0.1 + i % 5 * 0.2, 0.9 - i // 5 * 0.05, 0.01) for i in range(60)], "page long, text string, x double, y double, height double")
    lines = history.grid_lines(df)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(items") == 1 and plan.count("aggregate(") == 2
    assert [r.text for r in lines.orderBy("line").limit(2).collect()] == ["0 | 1 | 2 | 3 | 4", "5 | 6 | 0 | 1 | 2"]


# ---------------------------------------------------------------- the whole dataset


def test_dataset_runs_its_steps_again_after_the_fallback(spark):
    """What the fallback brings is derived like the rest; overrides come last; a broken bridge goes as a whole."""
    c = "company long, q_ord long, field string, value double, source string, source_order int, priority int, has_url boolean, has_date boolean, has_flags boolean"
    cell = lambda q, f, v, s="a", p=5: (1, q, f, float(v), s, 0, p, True, True, False)
    candidates = [cell(1, "revenue", 100), cell(1, "revenue", 90, "b", 4), cell(5, "revenue", 120), cell(5, "cost", 60), cell(5, "net", 30), cell(5, "tax", 6), cell(6, "revenue", 10), cell(6, "cost", 40)]
    wide = ["revenue", "cost", "gross", "sgna", "rnd", "other_opex", "opex", "op_income", "non_op", "pretax", "tax", "net"]
    second = {"revenue": 100.0, "cost": 70.0, "op_income": 10.0}
    parts = {
        "candidates": spark.createDataFrame(candidates, c), "segments": spark.createDataFrame([(1, 5, "x", 80.0), (1, 5, "y", 40.0)], "company long, q_ord long, member string, value double"),
        "fallback": spark.createDataFrame([(1, 1, *(second.get(f) for f in wide), "web")], "company long, q_ord long, " + ", ".join(f"{f} double" for f in wide) + ", source string"),
        "overrides": spark.createDataFrame([(1, 5, "net", 31.0)], "company long, q_ord long, field string, value double"), "rates": spark.createDataFrame([(1, 5, 2.0)], "company long, q_ord long, rate double"),
    }
    got = {r.q_ord: r for r in composition.dataset(parts).collect()}
    assert (got[1].revenue, got[1].cost, got[1].gross, got[1].opex, got[1].issues) == (100.0, 70.0, 30.0, 20.0, "missing-required:net")
    assert (got[5].gross, got[5].pretax, got[5].net, got[5].display_revenue, got[5].revenue_yoy, got[5].segments_mode, got[5].segment_share) == (60.0, 36.0, 31.0, 240.0, 20.0, "explicit", 1.0)
    assert (got[6].cleared, got[6].cost, got[6].gross, got[6].issues, got[6].segments_mode) == (True, None, None, "missing-required:op_income,net", "none")
    assert "display_revenue" not in composition.dataset(parts, upto="fallback").columns

"""Literal cases of choosing, bridging, resolving and formatting, nulls and empty inputs among them."""

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import bridge, checks, history, merging, repairs, selection


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_last_writer(spark):
    schema = "k int, source string, source_order int, kind string, n_rows long"
    data = [(1, "a", 0, "segments", 9), (1, "b", 1, "structure", 2), (1, "c", 2, "segments", 3), (1, "d", 3, "segments", 2), (2, "a", 0, "segments", 4), (2, "b", 1, "segments", 4), (2, "c", 2, "segments", 3), (3, "a", 0, "structure", 0), (4, "a", 0, "structure", 5), (4, "b", 1, "segments", 4)]
    got = rows(selection.last_writer(spark.createDataFrame(data, schema), ["k"]), "k")
    assert got == [(1, "c", "segments", 3), (2, "b", "segments", 4), (4, "a", "structure", 5)]


def test_axis_prefers_products_to_regions(spark):
    schema = "k int, axis string, axis_priority int, member string, end long, concept_priority int"
    data = [(1, "StatementBusinessSegmentsAxis", 100, m, 1, 2) for m in ("North America", "EMEA", "China")] + [(1, "ProductOrServiceAxis", 80, m, 1, 2) for m in ("Phones", "Tablets", "Services")]
    assert rows(selection.best_axis(spark.createDataFrame(data, schema), ["k"]), "k") == [(1, "ProductOrServiceAxis", 108, 1, 3)]


def test_merging_of_newest(spark):
    schema = "k int, n int, filed date, value double, name string, name_zh string"
    data = [(1, 1, None, 10.0, "a", ""), (1, 2, None, 5.0, "bb", "z"), (2, 1, None, None, "x", None)]
    df = spark.createDataFrame(data, schema).withColumn("filed", F.when(F.col("k") == 1, F.make_date(F.lit(2020), F.col("n"), F.lit(1))))
    got = [(r.k, r.value, r.name, r.name_zh) for r in selection.merge_newest(df, ["k"], "n", "name_zh").orderBy("k").collect()]
    assert got == [(1, 10.0, "bb", "z"), (2, None, "x", None)]
    same = spark.createDataFrame([(1, 1, 5.0, "ab"), (1, 2, 5.001, "abc"), (1, 3, 4.9, "abcdef")], "k int, n int, value double, name string").withColumn("filed", F.lit(None).cast("date"))
    assert [(r.value, r.name) for r in selection.merge_canonical(same, ["k"], "n").collect()] == [(5.001, "abc")]


def test_suspicious_expenses(spark):
    schema = "k int, member string, value double, total double, statement array<double>"
    echo = [(1, m, 3.0, 12.0, [50.0]) for m in ("rnd", "ga", "fulfillment", "sales_marketing")]
    equal = [(2, m, 3.0, 12.0, [50.0]) for m in "abcd"] + [(3, m, 3.0, 5.0, [50.0]) for m in "abcd"] + [(4, m, 3.0, 12.0, [3.04, None]) for m in "abcd"]
    other = [(5, "a", 3.0, 1.0, [3.0]), (6, "a", None, None, None), (6, "b", 0.01, None, None)]
    got = rows(selection.suspicious_expenses(spark.createDataFrame(echo + equal + other, schema), ["k"]), "k")
    assert got == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, False)]


def test_policy_falls_back_to_all(spark):
    quarters = spark.createDataFrame([("a", q, False, False) for q in range(4)] + [("b", q, q == 3, False) for q in range(4)] + [("c", 0, False, False)], "company string, q_ord long, has_revenue boolean, has_expense boolean")
    policies = spark.createDataFrame([("a", True, None, None, None), ("b", True, ["annual"], None, None)], "company string, classified_only boolean, cycles array<string>, need_revenue boolean, need_expense boolean")
    assert [r[:2] for r in rows(selection.by_policy(quarters, policies), "company", "q_ord")] == [*(("a", q) for q in range(4)), ("b", 3), ("c", 0)]


def test_scaled_flows_end_at_the_revenue(spark):
    df = spark.createDataFrame([(1, "a", 40.0, 100.0), (1, "b", 40.0, 100.0), (1, "c", 40.0, 100.0), (2, "a", 100.1, 100.0), (3, "a", None, 0.0)], "k int, member string, flow double, revenue double")
    assert [(r.k, r.flow, r.scaled) for r in selection.scale_flows(df, ["k"]).orderBy("k", "member").collect()] == [(1, 33.333, True), (1, 33.333, True), (1, 33.334, True), (2, 100.1, False), (3, 0.0, False)]


def test_names_are_resolved(spark):
    aliases = spark.createDataFrame([("apple", "aapl", 0, 1), ("applepark", "park", 0, 0), ("ap", "ap", 1, 0), ("x", "twtr", 0, 2)], "alias string, company string, source_order int, position int")
    queries = spark.createDataFrame([(q,) for q in ("apple", "apples", "le", "xy", "zzz", "", None)], "query string")
    got = {r.query: (r.company, r.exact) for r in merging.by_alias(queries, aliases).collect()}
    assert got == {"apple": ("aapl", True), "apples": ("aapl", False), "le": ("park", False), "xy": ("twtr", False), "zzz": (None, None), "": (None, None), None: (None, None)}


def test_attaching_synthesises_entries(spark):
    rows_type = "array<struct<member:string,value:double>>"
    entries = spark.createDataFrame([("a", 1, 10.0, []), ("a", 2, 20.0, [("own", 1.0)])], f"company string, q_ord long, revenue double, rows {rows_type}")
    structures = spark.createDataFrame([("a", 2, None, [("x", 5.0)]), ("a", 3, None, [("x", 5.0), ("y", -2.0)]), ("a", 4, 9.0, []), ("a", 5, None, [])], f"company string, q_ord long, display_revenue double, rows {rows_type}")
    seen = lambda how: [(r.q_ord, r.revenue, [x.member for x in r.rows], r.source) for r in merging.attach(entries, structures, how).orderBy("q_ord").collect()]
    assert seen("synthesise") == [(1, 10.0, [], "entry"), (2, 20.0, ["x"], "entry"), (3, 5.0, ["x", "y"], "structure"), (4, 9.0, [], "structure")]
    assert seen("fill") == [(1, 10.0, [], "entry"), (2, 20.0, ["own"], "entry")]
    assert seen("inner") == [(1, 10.0, [], "entry"), (2, 20.0, ["x"], "entry")]


def test_operating_stage(spark):
    schema = "k int, revenue double, cost double, gross double, opex double, op_income double, opex_sum double"
    data = [(1, 100.0, 60.0, 40.0, 80.0, None, None), (2, 100.0, 60.0, 40.0, 20.0, 20.1, None), (3, 100.0, 60.0, 40.0, 30.0, 20.0, None), (4, 100.0, 60.0, 40.0, None, 15.0, None), (5, 100.0, 60.0, 40.0, 120.0, None, None), (6, None, None, None, None, None, None), (7, 100.0, 60.0, 40.0, 80.0, None, 79.9)]
    got = [(r.k, r.total_costs, r.reliable, r.op_resolved, r.opex_resolved) for r in bridge.operating_stage(spark.createDataFrame(data, schema)).orderBy("k").collect()]
    assert got == [(1, True, False, 20.0, 20.0), (2, False, False, 20.1, 19.9), (3, False, False, 20.0, 20.0), (4, False, False, 15.0, 25.0), (5, False, False, None, 0.0), (6, False, False, None, None), (7, False, False, None, 0.0)]


def test_exceptions(spark):
    names = [["Upstream", "Downstream"], ["Streaming", "DVD"], ["Google Services", "Google Cloud", "All other segments"], ["Consumer", "MedTech"], ["Consumer", "Med Tech"], ["a"], [], ["Services", "Energy generation & storage"], ["Service revenue", "Processing"], ["x", "y"]]
    df = spark.createDataFrame(list(enumerate(names)), "k int, names array<string>")
    got = [r[1] for r in rows(df.select("k", bridge.segment_exception(F.col("names"))), "k")]
    assert got == ["partial-energy-business-disclosure", "legacy-business-model-disclosure", "partial-google-business-disclosure", None, "partial-healthcare-business-disclosure", None, None, "partial-business-line-disclosure", "partial-revenue-component-disclosure", None]


def test_residuals_and_outliers(spark):
    schema = "company string, q_ord long, member string, value double, revenue double"
    quarter = lambda q, a, b, rest: [("c", q, "a", a, 100.0), ("c", q, "b", b, 100.0), ("c", q, "otherrevenue", rest, 100.0)]
    df = spark.createDataFrame(quarter(1, 60.0, 30.0, 10.0) + quarter(2, 57.0, 38.0, 5.0) + quarter(3, 60.0, 30.0, 10.0), schema)
    got = {(r.q_ord, r.member): r.value for r in repairs.absorb_residual(df).collect()}
    assert got == {(1, "a"): 60.0, (1, "b"): 30.0, (1, "otherrevenue"): 10.0, (2, "a"): 60.333, (2, "b"): 39.667, (3, "a"): 60.0, (3, "b"): 30.0, (3, "otherrevenue"): 10.0}
    thin = spark.createDataFrame([("c", 1, "a", 50.0, 100.0), ("c", 1, "otherrevenue", 50.0, 100.0), ("c", 2, "a", 99.0, 100.0), ("c", 2, "t", 1.0, 100.0)], schema)
    assert [r[:4] for r in rows(repairs.drop_sparse(thin, ["t"]), "q_ord")] == [("c", 1, "reportedrevenue", 100.0), ("c", 2, "a", 99.0)]
    far = spark.createDataFrame([("c", q, "p", v, 100.0) for q, v in ((4, 10.0), (5, 90.0), (6, 20.0), (7, 95.0), (8, 30.0))], schema)
    assert [(r.q_ord, r.value) for r in repairs.neighbour_mean(far, "p").orderBy("q_ord").collect()] == [(4, 10.0), (5, 15.0), (6, 20.0), (7, 20.0), (8, 30.0)]


def test_layouts(spark):
    df = spark.createDataFrame([("c", 1, "a", 1.0), ("c", 1, "b", 50.0), ("c", 1, "d", 49.0), ("c", 2, "a", 0.0), ("c", 2, "b", None)], "company string, q_ord long, member string, height double")
    got = rows(history.fit_band(df, 0.0, 100.0, 0.0, 10.0), "q_ord", "member")
    assert got == [("c", 1, "a", 0.0, 10.0), ("c", 1, "b", 10.0, 55.454545), ("c", 1, "d", 55.454545, 100.0), ("c", 2, "a", 0.0, 50.0), ("c", 2, "b", 50.0, 100.0)]
    boxes = spark.createDataFrame([("c", 1, "a", 90.0, 20.0), ("c", 1, "b", 92.0, 20.0), ("c", 1, "d", 10.0, 10.0)], "company string, q_ord long, member string, center double, height double")
    assert rows(history.place_boxes(boxes, 0.0, 100.0, 5.0), "top") == [("c", 1, "d", 5.0, 15.0), ("c", 1, "a", 55.0, 75.0), ("c", 1, "b", 80.0, 100.0)]


def test_text(spark):
    df = spark.createDataFrame([("Net sales\n of goods 1,200\r\n\nCost\n(30)%\nrest",), (None,)], "t string")
    assert [r[0] for r in df.select(text.whole_lines(F.col("t"))).collect()] == [["Net sales of goods 1,200", "Cost (30)%", "rest"], []]
    assert [r[0] for r in df.select(text.section(F.col("t"), ["COST", "zzz"], ["rest"])).collect()] == ["Cost\n(30)%\n", ""]
    one = spark.range(1)
    shown = one.select(text.money_label(F.lit(-1.26), F.lit("eur"), True), text.money_label(F.lit(None).cast("double"), F.lit("USD")), text.percent_label(F.lit(2.0), True, True), text.points_label(F.lit(-0.31), "QoQ"))
    assert tuple(shown.first()) == ("(€1.3B)", "-", "+2%", "QoQ -0.3pp")
    detail = "array<struct<message:string,error:string,severity:string,layer:string,source:string,phase:string,kind:string,type:string>>"
    errors, details = text.error_bundle(F.col("e"), F.col("d"), "parser", "sec")
    df = spark.createDataFrame([([" a ", " "], None), (None, [(None, " b", None, "x", None, None, None, "io"), (" ", None, None, None, None, None, None, None)]), (None, None)], f"e array<string>, d {detail}")
    got = [(r[0], [tuple(x) for x in r[1]]) for r in df.select(errors, details).collect()]
    assert got == [(["a"], [("a", "error", "parser", "sec", None, None)]), (["b"], [("b", "error", "x", "sec", None, "io")]), ([], [])]


def test_classification_of_companies_without_any(spark):
    entries = spark.createDataFrame([("a", 1, False, False), ("b", 1, True, True), ("b", 2, False, True)], "company string, q_ord long, has_revenue boolean, has_expense boolean")
    policies = spark.createDataFrame([("b", True, "late", True, False)], "company string, gap_allowed boolean, gap_reason string, need_expense boolean, expense_gap_allowed boolean")
    got = {r.company: (r.status, r.warnings, r.blockers, r.revenue_lag) for r in checks.classification(entries, policies).collect()}
    assert got == {"a": ("error", "no-revenue", "latest-revenue-missing", None), "b": ("exception", "latest-revenue-gap,sparse-revenue", "", 1)}

"""Literal cases of the operators over labels, numbers, filings, histories and streams."""

import datetime
import random

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import checks, history, labels, merging, periods, repairs
from tallyloom.sources import filings, sinks
from tallyloom.streaming import events


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column, **values):
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_numbers(spark):
    cases = {"(1,234.5)": -1234.5, "− 3": -3.0, "12.5%": 12.5, "1,000 a": 1000.0, "-": None, "": None, "n/a": None, None: None}
    for text, want in cases.items():
        assert one(spark, S.parse_number(F.col("c")), c=text) == want


def test_languages(spark):
    cases = {"hello": "en", "营业收入": "zh", "收入 revenue": "mixed", "123": "unknown", "": "unknown", None: "unknown", "收" * 9 + "a": "zh"}
    for text, want in cases.items():
        assert one(spark, S.language_profile(F.col("c")), c=text) == want


def test_quarters(spark):
    day = lambda text: F.to_date(F.lit(text))
    got = spark.range(1).select(S.quarter_label(S.closing_quarter(day("2026-04-03"))), S.quarter_label(S.closing_quarter(day("2026-04-30"))), S.period_end(F.lit(8098)), S.quarter_ordinal(F.lit("2024Q3")), S.quarter_ordinal(F.lit("2024Q5"))).first()
    assert tuple(got) == ("2026Q1", "2026Q2", datetime.date(2024, 9, 30), 8098, None)
    ratio = spark.range(1).select(S.percent(F.lit(751.295), F.lit(1134.103)), S.percent(F.lit(1.0), F.lit(0.0))).first()
    assert tuple(ratio) == (66.246, None)


def test_trading_days(spark):
    cases = {"2026-05-01 21:00": True, "2026-12-01 22:00": True, "2026-05-02 21:00": False, "2026-12-25 22:00": False, "2027-03-26 21:00": False, "2026-05-01 22:00": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.refresh_due(F.to_timestamp("t")).alias("due"))
    assert {r.t: r.due for r in df.collect()} == cases


def test_labels(spark):
    got = spark.createDataFrame([("CloudandAiMember",), ("ServiceMember",), ("IPhoneMember",), ("Member",)], "m string").select(S.member_label(F.col("m")))
    assert [r[0] for r in got.collect()] == ["Cloud & AI", "Services", "iPhone", "Member"]
    assert one(spark, S.signature(F.col("c")), c="Games & News Services Segment games") == "game|news"


def test_taxonomy(spark):
    told = [("Sales & distribution", 1.5), ("Advertising", 0.7), ("Total opex", 9.9), ("Corporate overhead", 0.8), ("Interest and other expense", 0.4), ("Product development", 1.1), ("zebra", 1.0), ("Zebra", 3.0), (None, 1.0), ("x", None)]
    df = spark.createDataFrame([(1, n, v) for n, v in told], "company long, label string, value double")
    got = {r.taxonomy: r.value for r in labels.normalize_breakdown(df, "opex", ["company"]).collect()}
    assert got == {"sales_marketing": 2.2, "general_administrative": 0.8, "finance_expense": 0.4, "rnd": 1.1, "zebra": 3.0}


def test_finalize(spark):
    schema = "company long, q_ord long, span long, value double"
    plain = [(1, 8096 + i, i + 1, v) for i, v in enumerate((10.0, 23.0, 37.0, 55.0))]
    assert [r[2] for r in rows(periods.finalize(spark.createDataFrame(plain, schema)), "q_ord")] == [10.0, 13.0, 14.0, 18.0]
    falling = [*plain[:2], (1, 8098, 3, 20.0), plain[3]]
    assert [(r[1], r[2]) for r in rows(periods.finalize(spark.createDataFrame(falling, schema)), "q_ord")] == [(8096, 10.0), (8097, 13.0), (8099, 35.0)]
    assert periods.finalize(spark.createDataFrame([(1, 8099, 4, 9.0), (1, 8099, 1, None)], schema)).count() == 0


FACTS = "company long, start date, end date, value double, concept_priority int, namespace_priority int, filed date, accession string"


def _ymd(text):
    return datetime.date.fromisoformat(text)


def test_quarterise_loops(spark):
    ytd = [(1, _ymd("2024-01-01"), _ymd(end), v, 50, 20, _ymd(end) + datetime.timedelta(40), "a") for end, v in (("2024-03-31", 10.0), ("2024-06-30", 23.0), ("2024-09-30", 37.0), ("2024-12-31", 55.0))]
    old = (1, _ymd("2017-10-01"), _ymd("2017-12-31"), 9.0, 50, 20, _ymd("2018-02-01"), "a")
    got = rows(periods.quarterise(spark.createDataFrame([*ytd, old], FACTS), ["company"]), "q_ord")
    assert [(r[1], r[2].isoformat(), r[4], r[5]) for r in got] == [(8096, "2024-01-01", 10.0, False), (8097, "2024-04-01", 13.0, True), (8098, "2024-07-01", 14.0, True), (8099, "2024-10-01", 18.0, True)]
    assert [r[4] for r in rows(periods.quarterise(spark.createDataFrame(ytd[1:], FACTS), ["company"]), "q_ord")] == []


def _quarters_by_loop(facts, by_field):
    """The best facts by quarter in plain Python: loops until nothing changes."""
    days = lambda f: (f["end"] - f["start"]).days + 1

    def rank(f):
        gap = (f["filed"] - f["end"]).days
        timely, near = int(0 <= gap <= 210), -max(gap, 0)
        return (timely, f["p"], f["ns"], near, f["filed"]) if by_field else (timely, near, f["ns"], f["p"], f["filed"], f["acc"])

    direct, cumulated = {}, {}
    for f in sorted(facts, key=lambda f: (f["end"], days(f), f["filed"], f["p"])):
        target = direct if 45 <= days(f) <= 120 else cumulated if 121 <= days(f) <= 390 else None
        if target is not None and (f["end"] not in target or rank(f) > rank(target[f["end"]])):
            target[f["end"]] = f
    known, changed = dict(direct), True
    while changed:
        changed = False
        for f in sorted(cumulated.values(), key=lambda f: f["end"]):
            inside = [e for e in known.values() if e["start"] >= f["start"] and e["end"] < f["end"]]
            if f["end"] not in known and len(inside) == max(round(days(f) / 91) - 1, 1):
                known[f["end"]] = f | {"p": max(f["p"] - 1, 1), "start": max(e["end"] for e in inside) + datetime.timedelta(1), "v": f["v"] - sum(e["v"] for e in inside)}
                changed = True
    best = {}
    for f in known.values():
        q = f["end"].year * 4 + (f["end"].month - 1) // 3
        if q >= 8072 and (q not in best or rank(f) > rank(best[q])):
            best[q] = f
    return {q: (f["start"], f["end"], round(f["v"], 3)) for q, f in best.items()}


def test_quarterise_against_loop(spark):
    dice, facts = random.Random(5), {}
    for company in range(60):
        for n in range(25):
            start = datetime.date(dice.choice((2017, 2018, 2019)), dice.choice((1, 4, 7, 10)), 1)
            end = start + datetime.timedelta(dice.choice((30, 80, 90, 91, 119, 120, 180, 181, 272, 273, 364, 365, 389, 390)))
            filed = end + datetime.timedelta(dice.choice((20, 45, 209, 210, 211, 400)))
            facts.setdefault(company, []).append({"start": start, "end": end, "v": float(dice.randrange(100)), "p": dice.randrange(1, 4), "ns": dice.choice((18, 20)), "filed": filed, "acc": f"{n:02}"})
    data = [(c, f["start"], f["end"], f["v"], f["p"], f["ns"], f["filed"], f["acc"]) for c, fs in facts.items() for f in fs]
    df = spark.createDataFrame(data, FACTS)
    assert {(r[0], r[1]): tuple(r[2:5]) for r in rows(periods.quarterise(df, ["company"]))} == {(c, q): v for c, fs in facts.items() for q, v in _quarters_by_loop(fs, False).items()}
    unique = {c: list({(f["end"], f["p"], f["ns"], f["filed"]): f for f in fs}.values()) for c, fs in facts.items()}
    data = [(c, f["start"], f["end"], f["v"], f["p"], f["ns"], f["filed"], f["acc"]) for c, fs in unique.items() for f in fs]
    got = {(r[0], r[1]): tuple(r[2:5]) for r in rows(periods.quarterise(spark.createDataFrame(data, FACTS), ["company"], by_field=True))}
    assert got == {(c, q): v for c, fs in unique.items() for q, v in _quarters_by_loop(fs, True).items()}


def test_quarterise_segments(spark):
    schema = "company long, member string, label string, start date, end date, value double, concept_priority int, form string, filed date"
    fact = lambda m, label, end, v, form="10-Q": (1, m, label, _ymd("2024-01-01"), _ymd(end), v * 1e9, 100, form, _ymd(end) + datetime.timedelta(40))
    data = [fact("CloudMember", "Cloud", "2024-03-31", 3.0), fact("CloudMember", "Cloud Segment", "2024-06-30", 7.0), fact("CloudMember", "Cloud", "2024-09-30", 12.0)]
    data += [fact("DevicesMember", "Devices", "2024-03-31", 2.0), fact("GamesMember", "Games", "2024-03-31", 1.0), fact("XMember", "Games Studio", "2024-03-31", 1.0)]
    data += [fact("CloudDevicesMember", "Cloud and Devices", "2024-03-31", 5.0), fact("OperatingSegmentsMember", "All", "2024-03-31", 6.0), fact("TotalMember", "Consolidated", "2024-03-31", 6.0), fact("TinyMember", "Tiny", "2024-03-31", 0.001)]
    data += [fact("CloudMember", "Cloud", "2024-03-31", 9.0, "8-K")]
    got = rows(periods.quarterise_segments(spark.createDataFrame(data, schema), ["company"]), "q_ord", "member")
    assert [(r[1], r[2], r[3], r[6]) for r in got] == [(8096, "Cloud", 3.0, False), (8096, "Devices", 2.0, False), (8096, "Games Studio", 1.0, False), (8097, "Cloud", 4.0, True), (8098, "Cloud", 5.0, True)]


def test_member_quarters_abort(spark):
    cumulated = spark.createDataFrame([(1, 2, 2, "x", 5.0), (1, 2, 2, "y", 7.0)], "company long, q_ord long, span long, member string, value double")
    direct = spark.createDataFrame([(1, 1, "x", 2.0)], "company long, q_ord long, member string, value double")
    assert periods.member_quarters(cumulated, direct).count() == 0
    assert rows(periods.member_quarters(cumulated.filter("member = 'x'"), direct)) == [(1, 2, "x", 3.0)]


def test_reconcile(spark):
    schema = "company long, q_ord long, member string, value double, total double"
    data = [(1, 1, "a", 4.0, 10.0), (1, 1, "b", 5.0, 10.0), (2, 1, "a", 9.0, 3.0), (3, 1, "a", 6.0, 9.0), (3, 1, "b", 6.0, 9.0), (4, 1, "a", 1.0, 0.01), (5, 1, "a", 1.0, None)]
    got = rows(repairs.reconcile_to_total(spark.createDataFrame(data, schema)), "company", "member")
    assert got == [(1, 1, "a", 4.0), (1, 1, "b", 5.0), (1, 1, "residual", 1.0), (2, 1, "a", 3.0), (3, 1, "a", 4.5), (3, 1, "b", 4.5), (5, 1, "a", 1.0)]
    assert repairs.reconcile_to_total(spark.createDataFrame([], schema)).count() == 0


def test_fill_only(spark):
    schema = "company long, q_ord long, revenue double, net double"
    target = spark.createDataFrame([(1, 4, 12.3, None)], schema)
    unified = spark.createDataFrame([(1, 4, 13.1, 1.5), (1, 5, 13.1, 1.9), (1, 6, None, None)], schema)
    assert rows(merging.fill_only(target, unified, ["revenue", "net"]), "q_ord") == [(1, 4, 12.3, 1.5, "net"), (1, 5, 13.1, 1.9, "revenue,net")]


def test_validation_without_anything(spark):
    names = [*checks.CORE, "non_op", "gross_margin", "op_margin", "net_margin", "tax_rate"]
    df = spark.createDataFrame([(1, 1, *[None] * len(names))], "company long, q_ord long, " + ", ".join(f"{n} double" for n in names))
    got = checks.validation(df).first()
    assert (got.completeness, got.consistency, got.confidence, got.grade, got.issues) == (0.0, 0.5, 0.225, "low", "")


def test_facts(spark):
    fact = '{"start": "2024-01-01", "end": "2024-03-31", "val": 5, "form": "10-Q", "filed": "%s"}'
    doc = '{"cik": 1, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [%s, %s], "shares": [%s]}}}}}' % (fact % "2024-05-01", fact % "2016-05-01", fact % "2024-05-01")
    raw = spark.createDataFrame([(1, doc), (2, "no json"), (3, None)], "company long, json string")
    assert [(r.company, r.concept, r.val) for r in filings.company_facts(raw).collect()] == [(1, "Revenues", 5.0)]


def test_instance(spark):
    xml = """<x xmlns:i="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi">
      <i:context id="c"><i:entity><i:segment><d:explicitMember dimension="s:Axis">co:CloudMember</d:explicitMember></i:segment></i:entity><i:period><i:startDate>2024-01-01</i:startDate><i:endDate>2024-03-31</i:endDate></i:period></i:context>
      <Revenues contextRef="c">7.5</Revenues><Revenues contextRef="z">1</Revenues><Assets contextRef="c">9</Assets><NetSales contextRef="c">n/a</NetSales></x>"""
    docs = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "company long, xml string")
    assert [(r.company, r.concept, r.axis, r.member, r.value, r.priority) for r in filings.instance_facts(docs).collect()] == [(1, "Revenues", "Axis", "CloudMember", 7.5, 108)]


def test_cells(spark):
    page = "<TABLE><tr><td>a<br>b &amp; c</td><td> </td><td>(5</td><td>)</td></tr><tr></tr></TABLE><table><tr><th>x</th></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "k long, h string")
    assert rows(filings.html_cells(pages, "k", "h"), "k", "table_i", "row_i", "col_i") == [(1, 0, 0, 0, "a b & c"), (1, 0, 0, 1, "(5)"), (1, 1, 0, 0, "x")]


def test_headers(spark):
    cases = {"Q3 2024": (8098, 1), "Nine months ended September 30, 2024": (8098, 3), "截至2024年6月30日止六个月期间": (8097, 2), "Three months ended April 3, 2026": (8104, 1), "Revenue": None, None: None}
    for text, want in cases.items():
        got = one(spark, filings.header_quarter(F.col("c")), c=text)
        assert (tuple(got) if got else None) == want


def test_text_rows(spark):
    texts = spark.createDataFrame([(1, "Net sales 1,200 (30)\nCost none\nNet sales 9\nCost of sales 5"), (2, None)], "k long, text string")
    assert rows(filings.labelled_rows(texts, "k", {"revenue": ["net sales"], "cost": ["cost"]}), "field") == [(1, "cost", 3, [5.0]), (1, "revenue", 0, [1200.0, -30.0])]
    assert tuple(one(spark, filings.narrative(F.col("c")), c="Revenue was RMB 3.2 billion, down 5% on the year.")) == (3.2, -5.0)


def test_submissions(spark):
    schema = "company long, until string, form array<string>, accession array<string>, filed array<string>, document array<string>"
    raw = spark.createDataFrame([(1, None, ["10-Q", "8-K"], ["a", "b"], ["2024-01-01"], ["d", "e"]), (2, "2010-01-01", ["10-Q"], ["x"], ["2010-01-01"], ["y"])], schema)
    assert rows(filings.submissions(raw)) == [(1, "10-Q", "a", "2024-01-01", "d")]


def test_grid(spark):
    seen = [(1, "Revenue", 0.1, 0.9, 0.01), (1, "100", 0.5, 0.901, 0.01), (1, "Net income", 0.1, 0.4, 0.01), (1, "20", 0.5, 0.4, 0.01), (1, " ", 0.5, 0.4, 0.01)]
    df = spark.createDataFrame(seen, "page long, text string, x double, y double, height double")
    assert [r.text for r in history.grid_lines(df).orderBy("line").collect()] == ["Revenue | 100", "Net income | 20"]


def test_phases_and_gaps(spark):
    data = [(1, q, m, v, 10.0) for q, ms in enumerate(({"a": 5.0, "b": 5.0}, {"a": 5.0}, {"a": 5.0, "b": 5.0}, {"x": 6.0, "y": 4.0})) for m, v in ms.items()]
    df = spark.createDataFrame(data, "company long, q_ord long, member string, value double, revenue double")
    assert [r.phase for r in history.phases(df).orderBy("q_ord").collect()] == [0, 0, 0, 1]
    assert [(r.q_ord, r.member, r.value) for r in history.fill_gaps(df).filter("filled").collect()] == [(1, "b", 5.0)]


def test_best_subset(spark):
    data = [(1, 1, m, v, 10.0, 0.0, [m]) for m, v in (("a", 4.0), ("b", 3.0), ("c", 3.0), ("d", 10.0))]
    df = spark.createDataFrame(data, "company long, q_ord long, member string, value double, revenue double, penalty double, tokens array<string>")
    assert sorted(r.member for r in history.best_subset(df).collect()) == ["a", "b", "c"]


def test_best_subset_shortcuts(spark):
    def kept(cells, revenue, sums=(), targets=(), styled=False):
        data = [(1, 1, m, v, revenue, 0.0, [m]) for m, v in cells.items()]
        df = spark.createDataFrame(data, "company long, q_ord long, member string, value double, revenue double, penalty double, tokens array<string>")
        found = history.best_subset(df, aggregate=F.col("member").isin(*sums), targets=F.array(*(F.lit(t) for t in targets)).cast("array<string>"), styled=F.lit(styled))
        return sorted(r.member for r in found.collect())

    cells = {"a": 4.0, "b": 3.0, "c": 3.0, "all": 10.0}
    assert kept(cells, 10.0, sums=["all"]) == ["a", "b", "c"]  # adds up without the sum
    assert kept({"a": 4.0, "all": 10.0}, 10.0, sums=["all"]) == ["a", "all"]  # of two rows none goes: no good set, both are kept
    assert kept(dict.fromkeys("abc", 4.0), 12.0, sums=list("abc")) == ["a", "b", "c"]  # nothing else is left
    some = {"a": 6.0, "b": 3.0, "c": 3.0, "d": 1.0}
    assert kept(some, 9.0) == ["a", "b"]  # -40, as with c for b; with d -77
    assert kept(some, 9.0, targets=["d"]) == ["a", "b", "d"]
    seven = {m: 1.0 for m in "abcdefg"}
    assert kept(seven, 9.0, targets=["a"]) == list("abcdefg")  # 0.78 of the revenue, its target there
    assert kept({m: 1.0 for m in "abcdefgh"}, 7.0, styled=True) == list("abcdefgh")  # eight rows, as published
    assert len(kept({m: 1.0 for m in "abcdefgh"}, 7.0)) < 8
    assert len(kept({m: 1.0 for m in "abcdefgh"}, 4.0, targets=["a", "none"])) == 7  # no set has both: the largest seven


def test_layout(spark):
    df = spark.createDataFrame([(1, 1, "a", 98.0, 5.0), (1, 1, "b", 1.0, 6.0), (1, 1, "c", 1.0, 6.0)], "company long, q_ord long, member string, height double, center double")
    assert [(r.top, r.bottom) for r in history.fit_band(df, 0.0, 100.0, 0.0, 10.0).orderBy("member").collect()] == [(0.0, 80.0), (80.0, 90.0), (90.0, 100.0)]
    boxes = history.place_boxes(df.withColumn("height", F.lit(10.0)), 0.0, 100.0, 2.0).orderBy("member").collect()
    assert [(r.top, r.bottom) for r in boxes] == [(0.0, 10.0), (12.0, 22.0), (24.0, 34.0)]


def test_adapters_and_overrides(spark):
    registry = filings.Adapters()
    registry.register("x", 5, lambda s: s.range(1).select(F.col("id").alias("company")))
    registry.register("y", 7, lambda s: s.range(1).select(F.col("id").alias("company")))
    assert rows(registry.candidates(spark).select("source", "source_order", "priority"), "source") == [("x", 0, 5), ("y", 1, 7)]
    companies = spark.createDataFrame([(1, ["A B", "c"]), (2, ["none"])], "company long, names array<string>")
    records = spark.createDataFrame([("C", "two"), ("ab", "one")], "key string, value string")
    assert rows(filings.overrides(companies, records)) == [(1, "one")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 8000, 1.0), (1, 8004, 2.0), (2, 8001, 3.0)], "company long, q_ord long, revenue double")
    assert rows(sinks.latest_only(df).select("company", "revenue"), "company") == [(1, 2.0), (2, 3.0)]
    assert rows(sinks.last_quarters(df, 1, 8000).select("company", "q_ord"), "company") == [(1, 8000), (2, 8001)]
    sinks.write_dataset(df, str(tmp_path / "out"), 3)
    assert sinks.current(spark.read.parquet(str(tmp_path / "out")), 3).count() == 3
    (tmp_path / "a.json").write_text('{"a": 1}\nnot json\n')
    got = filings.read_json(spark, [str(tmp_path / "missing"), str(tmp_path / "a.json")], "a int").collect()
    assert [(r.a, r._corrupt_record) for r in got] == [(1, None), (None, "not json")]


def test_stream_drops_copies(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    events_ = spark.createDataFrame([(1, at, "a", 1.0), (1, at, "a", 1.0), (2, at, "a", 2.0)], "event_id long, ts timestamp, event_type string, value double")
    events_.write.parquet(str(tmp_path / "in"))
    stream = events.distinct_events(events.read_events(spark, str(tmp_path / "in")))
    events.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]

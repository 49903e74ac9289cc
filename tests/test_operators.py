"""Operators on literal cases, and every query with SQL against DuckDB."""

import numbers
import os

import duckdb
import pytest

import __spark_entry__
from tallyloom.functions import keys
from tallyloom.operators import breakdown, fusion, growth, periods
from tallyloom.plans import catalog as plans

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gap_separates_positional_and_calendar(spark):
    df = spark.createDataFrame([("a", 8092, 100.0), ("a", 8094, 120.0)], "company string, q_ord long, revenue double")
    assert rows(growth.positional(df).select("qoq"), "qoq") == [(None,), (20.0,)]
    assert rows(growth.calendar(df, False).select("qoq"), "qoq") == [(None,), (None,)]


def test_negative_prior(spark):
    df = spark.createDataFrame([("a", 1, -50.0), ("a", 2, 100.0), ("a", 3, 0.0), ("a", 4, 5.0)], "company string, q_ord long, revenue double")
    assert rows(growth.calendar(df, False).select("q_ord", "qoq"), "q_ord") == [(1, None), (2, -300.0), (3, -100.0), (4, None)]
    assert all(r[0] is None for r in rows(growth.calendar(df, True).select("qoq"), "qoq"))


def test_filling_keeps_given_growth(spark):
    df = spark.createDataFrame([("a", 4, 100.0, 5.0, 20.0, None, None), ("a", 5, 120.0, 6.0, 21.0, 7.5, 3.0), ("a", 8, 150.0, -4.0, 22.5, None, 9.0), ("a", 9, 90.0, 3.0, None, 8.5, None)], "company string, q_ord long, revenue double, net double, gross_margin double, qoq double, yoy double")
    names = ("qoq", "yoy", "net_yoy", "gross_margin_delta")
    assert rows(growth.calendar(df, False).select("q_ord", *names), "q_ord") == [(4, None, None, None, None), (5, 7.5, 3.0, None, None), (8, None, 9.0, -180.0, 2.5), (9, 8.5, -25.0, -50.0, None)]
    assert rows(growth.calendar(df, True).select("q_ord", "qoq", "yoy"), "q_ord") == [(4, None, None), (5, 20.0, None), (8, None, 50.0), (9, -40.0, -25.0)]


def test_positional_deltas(spark):
    data = [("a", q, 100.0 + q, float(net), 10.0 + q, None if q == 7 else 5.5) for q, net in ((1, 4), (2, 0), (3, 2), (5, 2), (7, 5), (9, 3))]
    df = spark.createDataFrame(data, "company string, q_ord long, revenue double, net double, op_margin double, yoy double")
    got = rows(growth.positional(df).select("q_ord", "net_yoy", "op_margin_delta", "yoy"), "q_ord")
    assert got == [(1, None, None, 5.5), (2, None, None, 5.5), (3, None, None, 5.5), (5, None, None, 5.5), (7, 25.0, 6.0, 5.94), (9, None, 7.0, 6.86)]


def test_mix_of_shares_and_given(spark):
    schema = "company string, q_ord long, member string, value double, revenue double, mode string, mix_pct double, yoy double, suppress_qoq boolean"
    data = [("a", 1, "x", 20.0, 200.0, "share", None, None, False), ("a", 5, "x", 50.0, 220.0, None, None, None, False), ("a", 6, "x", 0.0, 100.0, "share", 30.0, 7.0, False)]
    data += [("a", 1, "y", 60.0, 200.0, None, None, None, None), ("a", 5, "y", 66.0, 220.0, None, 31.0, None, None), ("a", 6, "y", 99.0, 100.0, None, None, None, True), ("a", 5, "z", 1.0, None, "share", None, None, None)]
    got = rows(growth.mix(spark.createDataFrame(data, schema)).select("q_ord", "member", "value", "mix_pct", "mix_delta", "yoy", "qoq"), "q_ord", "member")
    assert got == [
        (1, "x", 40.0, 20.0, None, None, None),
        (1, "y", 60.0, 30.0, None, None, None),
        (5, "x", 50.0, 22.7, 2.7, 25.0, None),
        (5, "y", 66.0, 31.0, 0.0, 10.0, None),
        (5, "z", 1.0, None, None, None, None),
        (6, "x", 30.0, 30.0, None, 7.0, -40.0),
        (6, "y", 99.0, 99.0, None, None, None),
    ]


def test_single_quarters(spark):
    df = spark.createDataFrame([("a", 8096 + i, v) for i, v in enumerate((10.0, 23.0, 37.0, 55.0))], "company string, q_ord long, ytd double")
    assert [r[0] for r in rows(periods.single_quarters(df).select("value", "q_ord"), "q_ord")] == [10.0, 13.0, 14.0, 18.0]


def test_contiguous_tail(spark):
    quarters = [2018 * 4, 2018 * 4 + 1, 2019 * 4 + 3, 2020 * 4, 2020 * 4 + 1, 2020 * 4 + 3, 2021 * 4, 2021 * 4 + 1, 2021 * 4 + 2]
    df = spark.createDataFrame([("a", q, 1.0) for q in quarters], "company string, q_ord long, revenue double")
    assert [r.q_ord for r in periods.contiguous_tail(df).orderBy("q_ord").collect()] == quarters[-4:]


def test_fuse_tie_takes_earlier_source(spark):
    schema = "company string, q_ord long, field string, value double, source string, source_order int, priority int, has_url boolean, has_date boolean, has_flags boolean"
    df = spark.createDataFrame([("a", 1, "f", 1.0, "x", 0, 2, True, True, False), ("a", 1, "f", 2.0, "y", 1, 2, True, True, False), ("a", 1, "f", None, "z", 2, 9, True, True, True)], schema)
    assert rows(fusion.fuse(df).select("source", "value"), "source") == [("x", 1.0)]


def test_as_of_tolerance(spark):
    facts = spark.sql("SELECT 'EUR' AS currency, date'2024-01-10' AS day UNION ALL SELECT 'EUR', date'2024-02-01'")
    rates = spark.sql("SELECT 'EUR' AS currency, date'2024-01-02' AS day, 1.0D AS rate UNION ALL SELECT 'EUR', date'2024-01-04', 2.0D")
    assert [r.rate for r in fusion.as_of(facts, rates).orderBy("day").collect()] == [2.0, None]


def test_fit_sums_to_total(spark):
    df = spark.createDataFrame([("a", 1, "x", 6.0, 10.0), ("a", 1, "y", 6.0, 10.0)], "company string, q_ord long, member string, value double, total double")
    assert [r.fitted for r in breakdown.fit_to_total(df).orderBy("member").collect()] == [5.0, 5.0]


def test_suspicious(spark):
    schema = "company string, q_ord long, member string, value double, total double"
    names = ("rnd", "sales_marketing", "general_administrative", "fulfillment", "finance_expense", "taxes_surcharges")
    echo = [("c", 1, n, 2.024, 78.579) for n in names] + [("c", 1, "x", 26.295, 78.579), ("c", 1, "y", 40.14, 78.579)]
    df = spark.createDataFrame([("a", 1, n, 0.0, 35.149) for n in names] + [("b", 1, n, float(i), 100.0) for i, n in enumerate(names)] + echo, schema)
    assert rows(breakdown.suspicious(df, ["company", "q_ord"]).select("company", "suspicious"), "company") == [("a", True), ("b", False), ("c", True)]


def test_keys(spark):
    df = spark.createDataFrame([("Cost & 收入 Member",)], "n string")
    got = df.select(keys.taxonomy_key("n"), keys.member_key("n"), keys.chart_key("n")).first()
    assert tuple(got) == ("cost收入member", "cost收入", "costandmember")


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_text = lambda df: sorted(zip(*([_shown(x) for x in df[c].astype(object)] for c in columns), strict=True))
    assert as_text(got) == as_text(want)


def _shown(x) -> str:
    """Numbers by value and days without a time, whatever type the column has."""
    text = str(x).removesuffix(" 00:00:00")
    if text in ("NaT", "nan", "<NA>", "None"):
        return "None"
    return repr(float(x)) if isinstance(x, numbers.Number) and not isinstance(x, bool) and text not in ("True", "False") else text


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Queries over statements written as lines of text, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.queries import _ST
from tallyloom.sources import statement_lines as sl
from tallyloom.sources.tables import read, statements

ALIASES = {"cost": ["Cost of revenue", "Total cost of revenue"], "revenue": ["Total revenue", "Revenue"], "tax": ["Income tax expense", "Provision for income taxes"]}


def _doc():
    return (F.col("company") * 100_000 + F.col("q_ord")).alias("doc")


def _whole(c):
    return F.floor(c).cast("long")


def _lined(rows: DataFrame, texts: list) -> DataFrame:
    return rows.select("doc", F.posexplode(F.filter(F.array(*texts), lambda x: x.isNotNull())).alias("line_i", "text"))


def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's quarter, twenty years on, beside that of a year before (a tenth less), under one of four kinds of headers."""
    own = statements(spark, sf_dir).select(_doc(), (F.col("q_ord") + 80).alias("q_ord"), *(_whole(F.col(c)).alias(c) for c in ("revenue", "cost", "tax")))
    year, quarter = F.floor(F.col("q_ord") / 4).cast("string"), F.col("q_ord") % 4
    before = (F.floor(F.col("q_ord") / 4) - 1).cast("string")
    day = F.element_at(F.array(*(F.lit(d) for d in ("March 31", "June 30", "September 30", "December 31"))), (quarter + 1).cast("int"))
    kind = F.col("doc") % 4
    named = F.concat_ws(" ", F.concat(F.lit("Q"), (quarter + 1).cast("string"), F.lit(" "), year), F.concat(F.lit("Q"), (quarter + 1).cast("string"), F.lit(" "), before))
    months = F.concat((quarter * 3 + 1).cast("string"), F.lit("-"), (quarter * 3 + 3).cast("string"), F.lit("月"))
    header = F.when(kind == 0, named).when(kind == 1, F.concat(F.lit("Three months ended "), day)).when(kind == 2, F.concat(F.lit("| Quarter ended | | "), day)).otherwise(F.concat(year, F.lit("年"), months, F.lit(" "), before, F.lit("年"), months))
    second = F.when(kind == 1, F.concat_ws(" ", year, before)).when(kind == 2, F.concat(F.lit("| "), year, F.lit(" | "), before))
    money = lambda x: F.format_number(x, 0)
    pair = lambda label, c: F.concat(F.lit(label), money(F.col(c)), F.lit(" "), money(_whole(F.col(c) * 0.9)))
    half = _whole(F.col("cost") / 2)
    texts = [
        F.lit("Condensed consolidated statement of income"), header, second, pair("Total revenue 7 ", "revenue"), F.lit("Cost of revenue:"), F.concat(F.lit("Goods "), money(half), F.lit(" "), money(half)), F.concat(F.lit("Services")), F.concat(money(F.col("cost") - half), F.lit(" 0")),
        F.concat(F.lit("Total cost of revenue ("), money(F.col("cost")), F.lit(") ("), money(_whole(F.col("cost") * 0.9)), F.lit(")")), F.lit("Provision for"), F.concat(F.lit("income taxes $ "), money(F.col("tax")), F.lit(" $ "), money(_whole(F.col("tax") * 0.9))),
    ]
    return _lined(own, texts)


def statement_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.statement_entries(statement_texts(spark, sf_dir), ALIASES)


def line_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sl.best_parses(statement_texts(spark, sf_dir), ALIASES)
    return told.filter("doc % 4 = 0").select("doc", "line_i", "label", "field", F.size("values").alias("n"), F.get("values", F.lit(0)).alias("first"))


def section_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    parses = sl.best_parses(statement_texts(spark, sf_dir), ALIASES)
    return sl.section_rows(parses, ("costofrevenue",), ("totalcostofrevenue",), ("tax",), 2).select("doc", "label", F.col("values")[0].alias("value"))


def rows_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-year figures, a quarter's twelve lines below, and a sentence; by hints of their quarter in most documents."""
    own = statements(spark, sf_dir).select(_doc(), "q_ord", *(_whole(F.col(c)).alias(c) for c in ("revenue", "cost", "tax")))
    money = lambda c: F.format_number(F.col(c), 0)
    cells = lambda *c: F.concat_ws(" ", *(x if not isinstance(x, str) else F.lit(x) for x in c))
    texts = [F.lit("Six months ended"), cells("Revenue", money("cost"), money("tax"), "1", "2"), *[F.lit("text")] * 12, F.lit("Three months ended, unaudited"), cells("(1) Revenue", money("revenue"), money("cost"), money("tax"), "5"), cells("Revenue was", "12 13"), cells("Cost of revenue (2)", money("cost"), "12%", "13")]
    hints = own.filter("q_ord % 3 <> 0").select("doc", "q_ord")
    best = sl.best_rows(_lined(own, texts), {"revenue": ["Revenue"], "cost": ["Cost of revenue"]}, hints)
    return best.select("doc", "field", F.col("line_i").alias("line"), "score", F.size("values").alias("n"), F.col("values")[0].alias("first"))


def cumulative_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' Chinese reports: quarterly ones, half-years and years, with an income statement from the year's start."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc"), F.concat(F.lit("20"), F.lpad((F.col("s_suppkey") % 25).cast("string"), 2, "0")).alias("y"), (F.col("s_suppkey") % 6).alias("k"))
    number = F.element_at(F.array(*(F.lit(x) for x in ("一", "二", "三", "四"))), (F.col("k") + 1).cast("int"))
    title = F.when(F.col("k") < 4, F.concat("y", F.lit("年第"), number, F.lit("季度报告"))).when(F.col("k") == 4, F.concat("y", F.lit("年半年度报告"))).otherwise(F.concat("y", F.lit("年年度报告")))
    pages = s.select("doc", title.alias("text"))
    told = sl.period_columns(_lined(s, [F.lit("合并利润表"), F.lit("项目 年初到报告期末 上年同期"), F.lit("营业收入 100 90")]), sl.period_context(pages))
    return told.select("doc", F.inline("columns"))


def best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a user's events: results, presentations, and others, by year; an address ends with the event's number, which may look like a year."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("https://x.test/"), F.when(F.col("event_id") % 3 == 0, "earnings-q").when(F.col("event_id") % 3 == 1, "presentation-earnings-q").otherwise("release-q"), (F.col("event_id") % 4 + 1).cast("string"), F.lit("-20"), (F.col("event_id") % 15 + 10).cast("string"), F.lit("-"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".pdf").otherwise(".htm")).alias("url"))
    return e.groupBy("user_id").agg(F.min(sl.url_rank(F.col("url"), r"-\d+(?=\.(?:pdf|htm)$)")).alias("r")).select("user_id", "r.kind", "r.url")


QUERIES = {f.__name__: f for f in (statement_grids, line_parses, section_details, rows_by_context, cumulative_columns, best_files)}

_TEXTS = f"""{_ST}, d AS (SELECT company * 100000 + q_ord AS doc, q_ord, CAST(floor(revenue) AS BIGINT) AS revenue, CAST(floor(cost) AS BIGINT) AS cost, CAST(floor(tax) AS BIGINT) AS tax FROM st),
    h AS (SELECT *, CAST(floor(cost / 2) AS BIGINT) AS half, CASE WHEN doc % 4 IN (1, 2) THEN 1 ELSE 0 END AS more FROM d)"""
_ONE = "CASE WHEN {0} >= 100000 THEN 1000.0 WHEN {0} >= 100 THEN 1000000.0 ELSE 1.0 END::DOUBLE"
_BEFORE = "floor({} * 0.9::DOUBLE)"
ORACLE_SQL = {
    "statement_grids": f"""WITH {_TEXTS}, u AS (SELECT *, {_ONE.format('revenue')} AS unit FROM h) SELECT doc, q_ord + 80 - 4 * k AS q_ord, 1 AS span, field, unit * CASE WHEN k = 0 THEN v ELSE {_BEFORE.format('v')} END AS value
        FROM (SELECT doc, q_ord, unit, unnest([{{field: 'revenue', v: revenue}}, {{field: 'cost', v: cost}}, {{field: 'tax', v: tax}}], recursive := true) FROM u), (VALUES (0), (1)) AS k(k)""",
    "line_parses": f"""WITH {_TEXTS}, y AS (SELECT *, CAST(q_ord // 4 + 20 AS DOUBLE) AS y, 'Q' || (q_ord % 4 + 1) AS q FROM h WHERE doc % 4 = 0),
        p AS (SELECT doc, unnest([{{i: 0, label: 'Condensed consolidated statement of income ' || q, field: NULL, n: 5, first: y}}, {{i: 1, label: q, field: NULL, n: 2, first: y}}, {{i: 2, label: 'Total revenue', field: 'revenue', n: 3, first: 7.0::DOUBLE}}, {{i: 3, label: 'Cost of revenue', field: 'cost', n: 0, first: NULL}}, {{i: 4, label: 'Goods', field: NULL, n: 2, first: CAST(half AS DOUBLE)}},
            {{i: 5, label: 'Services', field: NULL, n: 4, first: CAST(cost - half AS DOUBLE)}}, {{i: 7, label: 'Total cost of revenue', field: 'cost', n: 2, first: -CAST(cost AS DOUBLE)}}, {{i: 8, label: 'Provision for income taxes $', field: 'tax', n: 2, first: CAST(tax AS DOUBLE)}}, {{i: 9, label: 'income taxes $', field: NULL, n: 2, first: CAST(tax AS DOUBLE)}}], recursive := true) FROM y)
        SELECT doc, i AS line_i, label, field, n, first FROM p""",
    "section_details": f"""WITH {_TEXTS} SELECT doc, unnest([{{label: 'Goods', value: CAST(half AS DOUBLE)}}, {{label: 'Services', value: CAST(cost - half AS DOUBLE)}}], recursive := true) FROM h""",
    "rows_by_context": f"""WITH {_TEXTS} SELECT doc, 'revenue' AS field, CASE WHEN q_ord % 3 <> 0 THEN 15 ELSE 1 END AS line, CASE WHEN q_ord % 3 <> 0 THEN 28 ELSE 0 END AS score, 4 AS n, CAST(CASE WHEN q_ord % 3 <> 0 THEN revenue ELSE cost END AS DOUBLE) AS first FROM h
        UNION ALL SELECT doc, 'cost', 17, CASE WHEN q_ord % 3 <> 0 THEN 22 ELSE 0 END, 2, CAST(cost AS DOUBLE) FROM h""",
    "cumulative_columns": """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS doc, 2000 + s_suppkey % 25 AS y, CASE s_suppkey % 6 WHEN 4 THEN 2 WHEN 5 THEN 4 ELSE s_suppkey % 6 + 1 END AS q FROM supplier) SELECT doc, CAST((y - k) * 4 + q - 1 AS BIGINT) AS q_ord, CAST(q AS INTEGER) AS span FROM s, (VALUES (0), (1)) AS k(k)""",
    "best_files": """WITH e AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 1 END AS kind, event_id % 15 + 2010 AS y, event_id % 4 + 1 AS q, 'https://x.test/' || CASE event_id % 3 WHEN 0 THEN 'earnings-q' WHEN 1 THEN 'presentation-earnings-q' ELSE 'release-q' END || (event_id % 4 + 1) || '-20' || (event_id % 15 + 10) || '-' || event_id || CASE WHEN event_id % 2 = 0 THEN '.pdf' ELSE '.htm' END AS url FROM events)
        SELECT user_id, kind, url FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY kind, y DESC, q DESC, event_id % 2, url) = 1""",
}

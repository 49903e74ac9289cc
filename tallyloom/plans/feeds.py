"""Queries over documents and streams built from the tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.queries import _ST
from tallyloom.sources import filings, sinks
from tallyloom.sources.tables import sparse_statements, statements
from tallyloom.streaming import events


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as company-facts JSON, one document a company, and read back."""
    q = F.col("q_ord")
    day = lambda month: F.make_date(F.floor(q / 4).cast("int"), (q % 4 * 3 + month).cast("int"), F.lit(1))
    fact = F.struct(day(1).cast("string").alias("start"), F.last_day(day(3)).cast("string").alias("end"), F.col("revenue").alias("val"), F.when(q % 4 == 3, "10-K").when(q % 4 == 2, "8-K").otherwise("10-Q").alias("form"), F.lit("2020-01-01").alias("filed"))
    by_company = statements(spark, sf_dir).groupBy("company").agg(F.collect_list(fact).alias("facts"))
    units = F.struct(F.create_map(F.lit("USD"), F.col("facts"), F.lit("shares"), F.col("facts")).alias("units"))
    document = F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), units), F.lit("dei"), F.create_map(F.lit("Revenues"), units)).alias("facts")))
    facts = filings.dated(filings.company_facts(by_company.select("company", document.alias("json"))))
    return facts.select("company", "concept", "unit", "quarter", F.col("val").alias("value"))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as an HTML table of periods, one page a company, and turned round again."""
    cell = lambda c: F.concat(F.lit("<td class='n'>"), c, F.lit("</td>"))
    rows = statements(spark, sf_dir).select("company", "q_ord", F.concat(F.lit("Q"), (F.col("q_ord") % 4 + 1).cast("string"), F.lit(" "), F.floor(F.col("q_ord") / 4).cast("string")).alias("h"), F.col("revenue").cast("decimal(18,3)").cast("string").alias("r"), F.concat(F.lit("("), F.col("cost").cast("decimal(18,3)").cast("string"), F.lit("</td><td>)")).alias("c"))
    by_company = rows.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("q_ord", "h", "r", "c"))).alias("a"))
    line = lambda label, f: F.concat(F.lit(f"<TR><td>{label}</td>"), F.array_join(F.transform("a", lambda x: cell(x[f])), "\n"), F.lit("</TR>"))
    page = F.concat(F.lit("<p>x</p><table><tr><td> </td></tr></table><table border=1>"), line("Fiscal<br/>Quarter", "h"), line("Net&nbsp;sales", "r"), line("Cost &amp; expenses", "c"), F.lit("</table>"))
    cells = filings.html_cells(by_company.select("company", page.alias("html")), "company", "html")
    wide = filings.wide_table(cells, "company", "Fiscal Quarter", {"revenue": ["Revenue", "Net sales"], "cost": ["Cost & expenses"], "tax": ["Tax"]}, 1.0)
    return wide.select("company", filings.header_quarter(F.col("period"))["q_ord"].alias("q_ord"), "revenue", "cost", "tax")


def latest_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.latest_only(sparse_statements(spark, sf_dir))


def anchored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.last_quarters(sparse_statements(spark, sf_dir), 4, 7990)


def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream that brings each of them twice: copies are dropped, and the table is summed by day and type."""
    base = f"{events.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    stream = lambda: events.read_events(spark, f"{sf_dir}/events.parquet")
    events.run_to_table(events.distinct_events(stream().unionByName(stream())), f"{base}/out", f"{base}/state", "append")
    return events.daily_totals(spark.read.parquet(f"{base}/out"))


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals kept by the stream itself; each batch's whole result replaces the table."""
    base = f"{events.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events.run_to_table(events.daily_totals(events.read_events(spark, f"{sf_dir}/events.parquet")), f"{base}/out", f"{base}/state", "complete")
    return spark.read.parquet(f"{base}/out").drop("batch")


QUERIES = {f.__name__: f for f in (company_facts, html_tables, latest_quarter, anchored_window, streamed_totals, streamed_days)}

_SPARSE_SQL = """sp AS (SELECT l_partkey AS company, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS q_ord, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 3) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1, 2)"""

ORACLE_SQL = {
    "company_facts": f"WITH {_ST} SELECT company, 'Revenues' AS concept, 'USD' AS unit, (q_ord // 4) || 'Q' || (q_ord % 4 + 1) AS quarter, revenue AS value FROM st WHERE q_ord % 4 <> 2",
    "html_tables": f"WITH {_ST} SELECT company, q_ord, revenue, -cost AS cost, NULL::DOUBLE AS tax FROM st",
    "latest_quarter": f"WITH {_SPARSE_SQL} SELECT * FROM sp QUALIFY q_ord = max(q_ord) OVER (PARTITION BY company)",
    "anchored_window": f"WITH {_SPARSE_SQL}, a AS (SELECT *, max(q_ord <= 7990) OVER (PARTITION BY company) AS has FROM sp) SELECT company, q_ord, revenue FROM a WHERE q_ord <= 7990 OR NOT has QUALIFY row_number() OVER (PARTITION BY company ORDER BY q_ord DESC) <= 4",
    "streamed_totals": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 3) AS total FROM events GROUP BY 1, 2",
    "streamed_days": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 3) AS total FROM events GROUP BY 1, 2",
}

"""Queries over filings, documents and adapters made from the tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import fusion, history
from tallyloom.plans.queries import _ORD, _ST
from tallyloom.sources import filings, sinks
from tallyloom.sources.tables import order_statements, read, statements
from tallyloom.streaming import events

QUARTER = ["company", "q_ord"]


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as filings of their nations, in parallel arrays of which one is too long; old archives are skipped."""
    s = F.col("s_suppkey").cast("string")
    row = F.struct("s_suppkey", F.when(F.col("s_acctbal") > 0, "10-Q").otherwise("10-K").alias("form"), s.alias("accession"), F.concat(F.lit("20"), F.lpad((F.col("s_suppkey") % 30).cast("string"), 2, "0"), F.lit("-01-01")).alias("filed"), F.concat(F.lit("d"), s).alias("document"))
    own = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("company")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    raw = own.select("company", *(F.col(f"r.{n}").alias(n) for n in ("form", "accession", "document")), F.concat(F.col("r.filed"), F.array(F.lit("x"))).alias("filed"), F.when(F.col("company") % 2 == 0, F.array_max("r.filed")).alias("until"))
    return filings.submissions(raw, "2025-01-01")


def instance_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as instance documents, a context a quarter, and read back."""
    q = F.col("q_ord").cast("string")
    context = F.concat(F.lit('<xbrli:context id="c'), q, F.lit('"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="a:SegmentsAxis">a:M'), (F.col("q_ord") % 4).cast("string"), F.lit("</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>s"), q, F.lit("</xbrli:startDate><xbrli:endDate>e"), q, F.lit("</xbrli:endDate></xbrli:period></xbrli:context>"))
    fact = F.concat(F.lit('<us:Revenues contextRef="c'), q, F.lit('">'), F.col("revenue").cast("decimal(18,3)").cast("string"), F.lit('</us:Revenues><us:Assets contextRef="c'), q, F.lit('">1</us:Assets>'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q_ord", F.concat(context, fact).alias("x")))), lambda r: r["x"]), "")
    head = F.lit('<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:us="u">')
    documents = statements(spark, sf_dir).groupBy("company").agg(F.concat(head, body, F.lit("</xbrli:xbrl>")).alias("xml"))
    return filings.instance_facts(documents).select("company", "concept", "axis", "member", "start", "end", "value")


def override_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation")
    companies = nations.select(F.col("n_nationkey").alias("company"), F.array(F.concat(F.lit("x "), "n_name"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("names"))
    records = nations.select(F.when(F.col("n_regionkey") == 2, F.concat(F.lit("X"), F.lower("n_name"))).when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise("3").alias("key"), F.col("n_name").alias("value"))
    return filings.overrides(companies, records)


def statement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    body = F.concat(F.lit("Notes\n Net sales of the year "), F.col("c_custkey").cast("string"), F.lit(",000.5 ("), (F.col("c_custkey") % 7 + 2).cast("string"), F.lit(")\r\nnet sales 9\nCost of it\n"), F.when(F.col("c_acctbal") > 0, "Cost 12").otherwise("costs"))
    found = filings.labelled_rows(c.select("c_custkey", body.alias("text")), "c_custkey", {"revenue": ["net sales", "revenue"], "cost": ["cost"]})
    return found.select("c_custkey", "field", F.col("line_i").cast("long").alias("line_i"), F.array_join(F.transform("values", lambda v: v.cast("string")), "|").alias("values"))


def narrative_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    told = F.concat(F.when(F.col("c_acctbal") > 0, "Revenues were RMB ").otherwise("They came to US$"), k, F.lit(".25 "), F.when(F.col("c_mktsegment") == "BUILDING", "million").otherwise("billion"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit(", up by "), k, F.lit("%"))).otherwise(F.concat(F.lit(", a decrease of "), k, F.lit(".5%"))))
    return c.select("c_custkey", filings.narrative(F.when(F.col("c_mktsegment") != "MACHINERY", told)).alias("m")).select("c_custkey", "m.billions", "m.growth")


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as text on a page, three columns, a little askew."""
    own = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 6").groupBy("l_orderkey", "l_linenumber")
    lines = own.agg(*(F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity")))  # an order's numbers may repeat
    y = 0.9 - F.col("l_linenumber") * 0.05
    cell = lambda t, x, dy: F.struct(t.cast("string").alias("text"), F.lit(x).alias("x"), (y + dy).alias("y"), F.lit(0.01).alias("height"))
    cells = F.array(cell(F.col("l_returnflag"), 0.1, 0.001), cell(F.lit(" "), 0.3, 0.0), cell(F.col("l_linenumber"), 0.5, 0.0), cell(F.col("l_linestatus"), 0.52, 0.002), cell(F.col("l_quantity").cast("int"), 0.8, -0.001))
    seen = lines.select(F.col("l_orderkey").alias("page"), F.explode(cells).alias("c")).select("page", "c.*")
    return history.grid_lines(seen)


def versioned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written by two versions of the code, of which the current one's are read back."""
    base = f"{events.shared_folder(spark)}/sinks/{uuid.uuid4().hex}"
    own = statements(spark, sf_dir)
    sinks.write_dataset(own.filter("company < 10"), f"{base}/a", 1)
    sinks.write_dataset(own.filter("company >= 10"), f"{base}/b", 2)
    return sinks.current(spark.read.parquet(f"{base}/a").unionByName(spark.read.parquet(f"{base}/b")), 2)


def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index isn't there, so the whole dataset is read; a line that is no JSON stays as text."""
    base = f"{events.shared_folder(spark)}/json/{uuid.uuid4().hex}"
    n = read(spark, sf_dir, "nation")
    n.select(F.when(F.col("n_regionkey") < 3, F.to_json(F.struct("n_nationkey", "n_name"))).otherwise(F.col("n_name")).alias("value")).write.text(f"{base}/full")
    back = filings.read_json(spark, [f"{base}/index", f"{base}/full"], "n_nationkey int, n_name string")
    return back.select("n_nationkey", "n_name", F.col("_corrupt_record").alias("unread"))


def adapter_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = filings.Adapters()
    offered = lambda df, url: df.select(*QUARTER, F.lit("revenue").alias("field"), F.col("revenue").alias("value"), url.alias("has_url"), F.lit(True).alias("has_date"), F.lit(False).alias("has_flags"))
    registry.register("lines", 4, lambda s: offered(statements(s, sf_dir), F.col("q_ord") % 3 == 0))
    registry.register("orders", 5, lambda s: offered(order_statements(s, sf_dir), F.col("company") % 2 == 0))
    return fusion.fuse(registry.candidates(spark))


def dispatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    kind = F.when(segment == "BUILDING", "text/html; charset=x").when(segment == "MACHINERY", "application/PDF").when(segment == "FURNITURE", "text/plain")
    url = F.when(segment == "HOUSEHOLD", "http://x/a.HTM?q=1")
    body = F.when(segment == "FURNITURE", F.concat(F.lit("<b>"), name)).otherwise(F.concat(F.lit(" <html><script>x < 1</script><p>"), name, F.lit("  of</p><td>1</td><td>2</td></html>")))
    what, text = filings.document_text(body, kind, url)
    return c.select("c_custkey", what.alias("kind"), text.alias("text"))


def dispatched_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    one = lambda tag: lambda df: df.select("n_nationkey", F.lit(tag).alias("reader"))
    return filings.by_reader(n, "n_name", {"CHINA": one("own"), "JAPAN": one("other")}, one("generic"))


QUERIES = {f.__name__: f for f in (submission_rows, instance_documents, override_records, statement_labels, narrative_metrics, grid_lines, versioned_cache, json_fallback, adapter_fusion, dispatched_documents, dispatched_readers)}

ORACLE_SQL = {
    "submission_rows": """WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS company, CASE WHEN s_acctbal > 0 THEN '10-Q' ELSE '10-K' END AS form, CAST(s_suppkey AS VARCHAR) AS accession, '20' || lpad(CAST(s_suppkey % 30 AS VARCHAR), 2, '0') || '-01-01' AS filed, 'd' || s_suppkey AS document FROM supplier)
        SELECT * FROM s QUALIFY company % 2 = 1 OR max(filed) OVER (PARTITION BY company) >= '2025-01-01'""",
    "instance_documents": f"""WITH {_ST} SELECT company, 'Revenues' AS concept, 'SegmentsAxis' AS axis, 'M' || (q_ord % 4) AS member, 's' || q_ord AS start, 'e' || q_ord AS "end", revenue AS value FROM st""",
    "override_records": """WITH r AS (SELECT CASE n_regionkey WHEN 2 THEN 'x' || replace(lower(n_name), ' ', '') WHEN 1 THEN replace(lower(n_name), ' ', '') ELSE '3' END AS key, min(n_name) AS value FROM nation GROUP BY 1),
        o AS (SELECT n_nationkey AS company, unnest([(1, 'x' || replace(lower(n_name), ' ', '')), (2, replace(lower(n_name), ' ', '')), (3, CAST(n_regionkey AS VARCHAR))]) AS n FROM nation) SELECT company, arg_min(value, n[1]) AS value FROM o JOIN r ON r.key = n[2] GROUP BY 1""",
    "statement_labels": """SELECT c_custkey, 'revenue' AS field, 1 AS line_i, CASE WHEN c_custkey < 10000 THEN CAST(CAST(c_custkey * 1000 + 0.5 AS DECIMAL(18, 1)) AS VARCHAR) ELSE replace(printf('%.8E', c_custkey * 1000 + 0.5::DOUBLE), 'E+0', 'E') END || '|-' || (c_custkey % 7 + 2) || '.0' AS "values" FROM customer
        UNION ALL SELECT c_custkey, 'cost', 4, '12.0' FROM customer WHERE c_acctbal > 0""",
    "narrative_metrics": """WITH t AS (SELECT *, c_mktsegment <> 'MACHINERY' AS told FROM customer) SELECT c_custkey, CASE WHEN told THEN CASE WHEN c_mktsegment = 'BUILDING' THEN round((c_custkey + 0.25::DOUBLE) / 1000, 3) ELSE c_custkey + 0.25::DOUBLE END END AS billions, CASE WHEN told THEN CASE WHEN c_acctbal > 5000 THEN CAST(c_custkey AS DOUBLE) ELSE -(c_custkey + 0.5::DOUBLE) END END AS growth FROM t""",
    "grid_lines": """SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS line, l_returnflag || ' | ' || l_linenumber || ' ' || l_linestatus || ' | ' || CAST(l_quantity AS INTEGER) AS text FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2)""",
    "versioned_cache": f"WITH {_ST} SELECT * FROM st WHERE company >= 10",
    "json_fallback": "SELECT CASE WHEN n_regionkey < 3 THEN n_nationkey END AS n_nationkey, CASE WHEN n_regionkey < 3 THEN n_name END AS n_name, CASE WHEN n_regionkey >= 3 THEN n_name END AS unread FROM nation",
    "adapter_fusion": f"""WITH {_ST}, {_ORD}, c AS (SELECT company, q_ord, revenue AS value, 'lines' AS source, 0 AS o, CAST(5 + 2 * (q_ord % 3 = 0)::INT AS DOUBLE) AS score FROM st UNION ALL SELECT company, q_ord, revenue, 'orders', 1, 6 + 2 * (company % 2 = 0)::INT FROM ord)
        SELECT company, q_ord, 'revenue' AS field, value, source, score FROM c WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company, q_ord ORDER BY score DESC, o) = 1""",
    "dispatched_documents": """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'pdf' WHEN 'FURNITURE' THEN 'text' ELSE 'html' END AS kind, CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'FURNITURE' THEN '<b>' || c_name ELSE c_name || ' of' || chr(10) || '1 2' END AS text FROM customer""",
    "dispatched_readers": "SELECT n_nationkey, CASE n_name WHEN 'CHINA' THEN 'own' WHEN 'JAPAN' THEN 'other' ELSE 'generic' END AS reader FROM nation",
}

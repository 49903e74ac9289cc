"""Queries that apply the scalar functions to whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.sources.tables import quarter_of, read


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("("), price, F.lit(")"))).when(kind == 1, F.concat(F.lit("− "), price, F.lit(" a"))).when(kind == 2, F.concat(price, F.lit("%"))).otherwise("-")
    return read(spark, sf_dir, "orders").select("o_orderkey", S.parse_number(text).alias("value"))


def quarter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q_ord")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", quarter_of("o_orderdate").alias("q_ord"))
    label = S.quarter_label(q)
    return orders.select("o_orderkey", "q_ord", label.alias("label"), S.quarter_ordinal(label).alias("parsed"), S.period_end(q).alias("ends"), S.quarter_label(F.element_at(S.quarter_window(q, 4), 1)).alias("first_of_four"))


def closing_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", S.closing_quarter(day).alias("q_ord"), S.fiscal_quarter_end(F.year(day), F.quarter(day), F.lit(2), F.lit(30)).alias("fiscal_end"), S.is_trading_day(day).alias("trading"))


def scales_and_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", S.to_billions(price, 1e6).alias("billions"), S.scale_of_size(price).alias("scale"), F.round(S.tolerance(price), 6).alias("money"), F.round(S.tolerance(price % 20, 0.35), 6).alias("rate"), S.axis_step(price).alias("step"))


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", S.language_profile(F.col("text")).alias("language"))


def member_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    name = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.regexp_replace(F.initcap("p_type"), " ", "and"), F.lit("UsIotMember"))
    return part.select("p_partkey", S.member_label(name).alias("label"), S.signature(S.member_label(name)).alias("signature"), S.slug(F.col("p_name")).alias("slug"), S.ticker(F.col("p_brand")).alias("ticker"))


def rejected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" Net Income"))).otherwise(F.col("p_name"))
    concept = F.when(F.col("p_partkey") % 3 == 0, "NetSales").when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("Revenues"))).otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", S.rejected(label, F.col("p_type")).alias("rejected"), S.concept_priority(concept).alias("priority"))


QUERIES = {f.__name__: f for f in (number_parse, quarter_keys, closing_quarters, scales_and_tolerances, language_profiles, member_labels, rejected_labels)}

_CAMEL = "array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split({0}, ' ')], '{1}')"
_RULES = [("(Member|Segment)$", ""), ("([A-Za-z])and([A-Z])", r"\1And\2"), ("([a-z0-9])([A-Z])", r"\1 \2"), ("([A-Z]+)([A-Z][a-z])", r"\1 \2"), (" And ", " & "), (r"\bUs\b", "US"), (r"\bIot\b", "IoT"), (r"\s+", " ")]
_LABEL = f"{_CAMEL.format('p_name', '')} || {_CAMEL.format('p_type', 'and')} || 'UsIotMember'"
for _pattern, _to in _RULES:
    _LABEL = f"regexp_replace({_LABEL}, '{_pattern}', '{_to}', 'g')"

#: The holidays of each year in the orders, with Easter as in the calendars of those years. A New Year's Day on a Saturday
#: falls into the year before, whose list doesn't hold it.
_HOLIDAYS = """y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
    f AS (SELECT make_date(y, m, d) AS dt FROM y, (VALUES (1, 1), (6, 19), (7, 4), (12, 25)) v(m, d)),
    n AS (SELECT CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS dt FROM y),
    w AS (SELECT dt, isodow(dt) AS wd, month(dt) AS m, (day(dt) - 1) // 7 + 1 AS nth FROM n),
    hol AS (SELECT CAST(CASE isodow(dt) WHEN 6 THEN dt - 1 WHEN 7 THEN dt + 1 ELSE dt END AS DATE) AS dt FROM f WHERE NOT (isodow(dt) = 6 AND month(dt) = 1)
        UNION SELECT dt FROM w WHERE (wd = 1 AND ((m IN (1, 2) AND nth = 3) OR (m = 9 AND nth = 1) OR (m = 5 AND day(dt) > 24))) OR (wd = 4 AND m = 11 AND nth = 4)
        UNION SELECT dt - 2 FROM (VALUES (DATE '1992-04-19'), (DATE '1993-04-11'), (DATE '1994-04-03'), (DATE '1995-04-16'), (DATE '1996-04-07'), (DATE '1997-03-30'), (DATE '1998-04-12'), (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15'), (DATE '2002-03-31')) e(dt))"""

ORACLE_SQL = {
    "number_parse": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN -p WHEN 1 THEN -p WHEN 2 THEN p END AS value FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS p FROM orders)""",
    "quarter_keys": """WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS q_ord, o_orderdate AS d FROM orders)
        SELECT o_orderkey, q_ord, year(d) || 'Q' || quarter(d) AS label, q_ord AS parsed, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ends, year(d - INTERVAL 9 MONTH) || 'Q' || quarter(date_trunc('quarter', d) - INTERVAL 9 MONTH) AS first_of_four
        FROM o""".replace("year(d - INTERVAL 9 MONTH)", "year(date_trunc('quarter', d) - INTERVAL 9 MONTH)"),
    "closing_quarters": f"""WITH {_HOLIDAYS}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT *, CASE WHEN month(d) % 3 = 1 AND day(d) <= 7 THEN d - 7 ELSE d END AS c, last_day(CAST(make_date(year(d), 2, 1) - to_months(CAST(3 * (4 - quarter(d)) AS INT)) AS DATE)) AS e FROM o)
        SELECT o_orderkey, CAST(year(c) * 4 + quarter(c) - 1 AS BIGINT) AS q_ord, make_date(year(e), month(e), least(30, day(e))) AS fiscal_end, isodow(d) < 6 AND d NOT IN (SELECT dt FROM hol) AS trading FROM s""",
    "scales_and_tolerances": """SELECT o_orderkey, round(o_totalprice * 1e6 / 1e9, 3) AS billions, CASE WHEN o_totalprice >= 100000 THEN 1e3 WHEN o_totalprice >= 100 THEN 1e6 ELSE 1.0::DOUBLE END AS scale, round(greatest(0.12::DOUBLE, abs(o_totalprice) * 0.03::DOUBLE), 6) AS money,
        round(greatest(0.35::DOUBLE, abs(o_totalprice % 20) * 0.03::DOUBLE), 6) AS rate, CASE WHEN u < 1.5 THEN 1 WHEN u < 3 THEN 2 WHEN u < 7 THEN 5 ELSE 10 END * p AS step
        FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(o_totalprice / 6))) AS p, o_totalprice / 6 / pow(10.0::DOUBLE, floor(log10(o_totalprice / 6))) AS u FROM orders)""",
    "language_profiles": """WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
        SELECT doc_id, CASE WHEN coalesce(h + l, 0) = 0 THEN 'unknown' WHEN h / (h + l) > 0.85 THEN 'zh' WHEN h / (h + l) >= 0.15 THEN 'mixed' ELSE 'en' END AS language FROM n""",
    "member_labels": f"""WITH p AS (SELECT *, trim({_LABEL}) AS label FROM part),
        w AS (SELECT *, [x for x in regexp_split_to_array(replace(lower(label), '&', ' and '), '[^a-z0-9]+') if x NOT IN ('', 'and', 'seg', 'segment', 'segments', 'member', 'service', 'services')] AS words FROM p)
        SELECT p_partkey, label, array_to_string(list_sort(list_distinct([CASE WHEN length(x) IN (4, 5) AND x LIKE '%s' AND x NOT IN ('news', 'this', 'us') THEN x[:-2] ELSE x END for x in words])), '|') AS signature,
        trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(upper(p_brand), '[^A-Z0-9]+', '', 'g') AS ticker FROM w""",
    "rejected_labels": """SELECT p_partkey, regexp_matches(regexp_replace(lower(CASE WHEN p_partkey % 5 = 0 THEN p_name || ' Net Income' ELSE p_name END), '[^a-z0-9]', '', 'g') || ' ' || lower(p_type), 'total|netincome') AS rejected,
        CASE p_partkey % 3 WHEN 0 THEN 98 WHEN 1 THEN 70 ELSE -1 END AS priority FROM part""",
}

"""Filings as rows: nested facts, instance documents, submissions, tables in HTML, overrides."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.functions.scalars import closing_quarter, concept_priority, iso_date, is_money_unit, parse_number, quarter_label

FACT = "struct<start:string,end:string,val:double,accn:string,fy:string,fp:string,form:string,filed:string,frame:string>"
FACTS = f"struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"

#: Forms that hold statements, and how far a namespace is preferred.
FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A", "6-K", "6-K/A")
NAMESPACES = {"us-gaap": 20, "ifrs-full": 18}


def company_facts(raw: DataFrame, since: str = "2017-01-01", forms: tuple[str, ...] = FORMS) -> DataFrame:
    """A1: one row for each fact of company-facts documents (company, json).

    Kept are money units, known namespaces, the given forms, filings of `since` or later (or undated) and facts with both dates and a
    number. Documents that don't parse, and null ones, give no rows. Documents are exploded, never grouped.
    """
    parsed = raw.select("company", F.from_json("json", FACTS).alias("d")).select("company", F.explode("d.facts").alias("namespace", "concepts"))
    units = parsed.filter(F.col("namespace").isin(*NAMESPACES)).select("company", "namespace", F.explode("concepts").alias("concept", "c")).select("company", "namespace", "concept", F.explode("c.units").alias("unit", "facts"))
    facts = units.filter(is_money_unit(F.col("unit"))).select("company", "namespace", "concept", "unit", F.explode("facts").alias("f")).select("company", "namespace", "concept", "unit", "f.*")
    dated = (F.coalesce("start", F.lit("")) != "") & (F.coalesce("end", F.lit("")) != "")
    return facts.filter(F.col("form").isin(*forms) & dated & ((F.coalesce("filed", F.lit("")) == "") | (F.col("filed") >= since)) & F.col("val").isNotNull() & ~F.isnan("val"))


def submissions(raw: DataFrame, since: str = "2017-01-01") -> DataFrame:
    """A3: one row for each filing of submissions whose form, accession, date and document come as parallel arrays.

    Arrays of unlike length end with the shortest. Archives whose last filing (`until`) is before `since` are skipped.
    """
    names = ("form", "accession", "filed", "document")
    used = raw.filter(F.col("until").isNull() | (F.col("until") == "") | (F.col("until") >= since))
    shortest = F.least(*(F.size(n) for n in names))
    return used.select("company", F.explode(F.slice(F.arrays_zip(*names), F.lit(1), shortest)).alias("r")).select("company", *(F.col(f"r.{n}").cast("string").alias(n) for n in names))


def instance_facts(documents: DataFrame) -> DataFrame:
    """A2: revenue facts of instance documents (company, xml) that belong to a dimension's member.

    Contexts without both dates, facts of other concepts (negative priority) or without a number, and those without a member, go. A
    context with several dimensions gives a row for each. A document that doesn't parse, or is null, gives no rows.
    """
    name = lambda tag: tag.rpartition("}")[2]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for company, text in zip(frame["company"], frame["xml"]):
                try:
                    root = ElementTree.fromstring(text or "")
                except ElementTree.ParseError:
                    continue
                contexts = {}
                for context in root:
                    if name(context.tag) != "context":
                        continue
                    parts = {name(e.tag): (e.text or "").strip() for e in context.iter()}
                    members = [(e.get("dimension", ""), (e.text or "").strip()) for e in context.iter() if name(e.tag) == "explicitMember"]
                    if parts.get("startDate") and parts.get("endDate"):
                        contexts[context.get("id")] = (parts["startDate"], parts["endDate"], members)
                for fact in root:
                    start, end, members = contexts.get(fact.get("contextRef"), (None, None, []))
                    rows += [(company, name(fact.tag), axis, member, start, end, (fact.text or "").strip()) for axis, member in members if member]
            yield pd.DataFrame(rows, columns=["company", "concept", "axis", "member", "start", "end", "value"])

    rows = documents.select("company", "xml").mapInPandas(parse, "company long, concept string, axis string, member string, start string, end string, value string")
    facts = rows.withColumn("value", F.col("value").try_cast("double")).withColumn("priority", concept_priority(F.col("concept")))
    return facts.filter(F.col("value").isNotNull() & (F.col("priority") >= 0)).withColumn("member", F.regexp_replace("member", "^.*:", "")).withColumn("axis", F.regexp_replace("axis", "^.*:", ""))


@F.pandas_udf(StringType())
def _unescape(cells: pd.Series) -> pd.Series:
    return cells.map(html.unescape, na_action="ignore")


def html_cells(pages: DataFrame, key: str, text: str) -> DataFrame:
    """A4: one row for each cell of a page's tables: key, table_i, row_i, col_i (all from 0) and text.

    Line breaks become blanks, tags go, entities are resolved, white space is one blank. Empty cells, rows and tables don't count; a
    lone ")" or "%" joins the cell before. Pages without tables and null ones give no rows. Tables inside tables end with the inner.
    """
    find = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    tables = pages.select(F.col(key).alias(key), F.posexplode(find(F.col(text), r"(?is)<table\b.*?</table>", 0)).alias("_t", "_html"))
    rows = tables.select(key, "_t", F.posexplode(find(F.col("_html"), r"(?is)<tr\b.*?</tr>", 0)).alias("_r", "_html"))
    cells = rows.select(key, "_t", "_r", F.posexplode(find(F.col("_html"), r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", 1)).alias("_c", "_html"))
    bare = F.regexp_replace(F.regexp_replace("_html", r"(?i)<br\s*/?>", " "), "<[^>]+>", " ")
    clean = cells.select(key, "_t", "_r", "_c", F.trim(F.regexp_replace(_unescape(bare), r"[\s ]+", " ")).alias("text")).filter(F.col("text") != "")
    by_row = clean.groupBy(key, "_t", "_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "text"))), lambda c: c["text"]).alias("_cells"))
    glue = lambda done, c: F.when(c.isin(")", "%") & (F.size(done) > 0), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), c)))).otherwise(F.concat(done, F.array(c)))
    glued = by_row.select(key, "_t", "_r", F.aggregate("_cells", F.array().cast("array<string>"), glue).alias("_cells"))
    numbered = glued.groupBy(key, "_t").agg(F.array_sort(F.collect_list(F.struct("_r", "_cells"))).alias("_rows"))
    by_page = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_t", "_rows"))).alias("_tables"))
    out = by_page.select(key, F.posexplode("_tables").alias("table_i", "_x")).select(key, "table_i", F.posexplode("_x._rows").alias("row_i", "_y"))
    return out.select(key, "table_i", "row_i", F.posexplode("_y._cells").alias("col_i", "text"))


def wide_table(cells: DataFrame, key: str, header: str, aliases: dict[str, list[str]], scale: float = 1000.0) -> DataFrame:
    """A5: tables of labels by periods turned round: one row for each column of the header row, one field for each alias list.

    A field is the row of the first alias that is present, its number divided by `scale` (3 digits); null where there is none.
    """
    table = [key, "table_i"]
    labels = cells.filter(F.col("col_i") == 0).select(*table, "row_i", F.col("text").alias("label"))
    values = cells.filter(F.col("col_i") > 0).join(labels, [*table, "row_i"])
    fields = [F.struct(F.lit(rank).alias("rank"), F.lit(field).alias("field"), F.lit(alias).alias("label")) for field, names in aliases.items() for rank, alias in enumerate(names)]
    known = F.filter(F.array(*fields), lambda f: f["label"] == F.col("label"))
    named = values.withColumn("_f", F.explode(known))
    picked = [F.min_by("text", F.when(F.col("_f.field") == field, F.struct("_f.rank", "row_i"))).alias(field) for field in aliases]
    periods = values.filter(F.col("label") == header).select(*table, "col_i", F.col("text").alias("period"))
    wide = named.groupBy(*table, "col_i").agg(*picked)
    return periods.join(wide, [*table, "col_i"], "left").select(*table, "col_i", "period", *(F.round(parse_number(F.col(f)) / scale, 3).alias(f) for f in aliases))


def header_quarter(c: Column) -> Column:
    """K1: a header's period as (q_ord, span): "Q3 2024", "… three months ended September 30, 2024" or 截至2024年9月30日止三个月期间; else null."""
    short = r"^\s*Q([1-4])\s+(\d{4})\s*$"
    ended = r"(?i)\b(three|six|nine|twelve) months ended\s+([a-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    chinese = r"截至\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日止\s*(12|[369]|十二|三|六|九)\s*个月期间"
    get = lambda pattern, i: F.regexp_extract(c, pattern, i)
    month = F.array_position(F.array(*(F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))), F.lower(F.substring(get(ended, 2), 1, 3)))
    day = F.try_to_date(F.concat_ws("-", get(ended, 4), month.cast("string"), get(ended, 3)), "yyyy-M-d")
    western = F.create_map(*(F.lit(x) for pair in {"three": 1, "six": 2, "nine": 3, "twelve": 4}.items() for x in pair))
    eastern = F.create_map(*(F.lit(x) for pair in {"3": 1, "三": 1, "6": 2, "六": 2, "9": 3, "九": 3, "12": 4, "十二": 4}.items() for x in pair))
    parts = lambda q, span: F.struct(q.cast("long").alias("q_ord"), span.cast("int").alias("span"))
    quarter = get(short, 2).try_cast("long") * 4 + get(short, 1).try_cast("long") - 1
    at = get(chinese, 1).try_cast("long") * 4 + F.floor((get(chinese, 2).try_cast("long") - 1) / 3)
    return F.when(c.rlike(short), parts(quarter, F.lit(1))).when(day.isNotNull(), parts(closing_quarter(day), F.try_element_at(western, F.lower(get(ended, 1))))).when(c.rlike(chinese), parts(at, F.try_element_at(eastern, get(chinese, 4))))


def labelled_rows(texts: DataFrame, key: str, aliases: dict[str, list[str]]) -> DataFrame:
    """K4: numbers of the first line that begins with a field's alias, fields in order of lines: key, field, line_i, values.

    Lines are taken whole, from the whole text; a line's numbers may have commas, brackets or dashes. Lines without any don't count.
    """
    lines = texts.select(key, F.posexplode(F.split("text", r"\r?\n")).alias("line_i", "line"))
    low = F.lower(F.trim("line"))
    field = F.coalesce(*(F.when(F.greatest(*(low.startswith(a.lower()) for a in names), F.lit(False)), F.lit(f)) for f, names in aliases.items()), F.lit(None).cast("string"))
    numbers = F.transform(F.regexp_extract_all("line", F.lit(r"\(?[-−–—]?\d[\d,]*(?:\.\d+)?\)?"), F.lit(0)), parse_number)
    found = lines.select(key, "line_i", field.alias("field"), numbers.alias("values")).filter(F.col("field").isNotNull() & (F.size("values") > 0))
    return found.groupBy(key, "field").agg(F.min_by(F.struct("line_i", "values"), "line_i").alias("_b")).select(key, "field", "_b.line_i", "_b.values")


def narrative(c: Column) -> Column:
    """K8: "RMB 3.2 billion … up 5%" as (value in billions, growth in per cent, negative if down); null without an amount."""
    amount = r"(?i)(?:RMB|US\$|\$)\s*([\d,]+(?:\.\d+)?)\s*(billion|million)"
    change = r"(?i)\b(up|down|increased?|decreased?|grew|fell)\b[^.%]*?(\d+(?:\.\d+)?)\s*%"
    value = parse_number(F.regexp_extract(c, amount, 1)) / F.when(F.lower(F.regexp_extract(c, amount, 2)) == "million", 1000).otherwise(1)
    growth = F.regexp_extract(c, change, 2).try_cast("double") * F.when(F.lower(F.regexp_extract(c, change, 1)).rlike("^(down|decrease|fell)"), -1).otherwise(1)
    return F.when(value.isNotNull(), F.struct(F.round(value, 3).alias("billions"), growth.alias("growth")))


def overrides(companies: DataFrame, records: DataFrame) -> DataFrame:
    """A10: each company's record, by its first name (of `names`, in order) that any record's key is; unmatched companies go.

    Keys and names compare without case and blanks; of records with equal keys the smallest value counts.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    offered = companies.select("company", F.posexplode("names").alias("_i", "_n")).withColumn("_k", plain(F.col("_n")))
    known = records.groupBy(plain(F.col("key")).alias("_k")).agg(F.min("value").alias("value"))
    return offered.join(known, "_k").groupBy("company").agg(F.min_by("value", "_i").alias("value"))


def read_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first path that can be read; lines that are no JSON become rows with the text in _corrupt_record."""
    error: Exception | None = None
    for path in paths:
        try:
            return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
        except Exception as e:  # noqa: BLE001 - a missing path: the next is the fallback
            error = e
    raise FileNotFoundError(f"none of {paths} can be read") from error


class Adapters:
    """Sources that offer candidates, in order of registration, with their priorities."""

    def __init__(self) -> None:
        self._all: list[tuple[str, int, Callable[[SparkSession], DataFrame]]] = []

    def register(self, name: str, priority: int, run: Callable[[SparkSession], DataFrame]) -> None:
        self._all.append((name, priority, run))

    def candidates(self, spark: SparkSession) -> DataFrame:
        """Rows (company, q_ord, field, value, has_url, has_date, has_flags) of all sources, named, ordered and prioritised for fusion."""
        parts = [run(spark).withColumn("source", F.lit(name)).withColumn("source_order", F.lit(i)).withColumn("priority", F.lit(priority)) for i, (name, priority, run) in enumerate(self._all)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def dated(facts: DataFrame) -> DataFrame:
    """Facts with their quarter and days from start to end; facts whose dates are no dates go."""
    rows = facts.withColumn("start", iso_date(F.col("start"))).withColumn("end", iso_date(F.col("end"))).filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    q = closing_quarter(F.col("end"))
    return rows.withColumn("q_ord", q).withColumn("quarter", quarter_label(q)).withColumn("days", F.datediff("end", "start") + 1)


def document_text(body: Column, content_type: Column, url: Column) -> tuple[Column, Column]:
    """What kind a document is (html, text or pdf, by its type, else its name's ending, else its first bytes) and its text: without
    tags, scripts and styles for html, lines kept; null for a pdf, whose text needs an engine that isn't here. A null body is empty."""
    raw, name = F.coalesce(body, F.lit("")), F.lower(F.coalesce(url, F.lit("")))
    told = F.lower(F.coalesce(content_type, F.lit("")))
    by_name = F.when(name.rlike(r"\.pdf([?#]|$)"), "pdf").when(name.rlike(r"\.x?html?([?#]|$)"), "html").when(name.rlike(r"\.(txt|csv)([?#]|$)"), "text")
    kind = F.when(told.contains("pdf"), "pdf").when(told.contains("html"), "html").when(told.startswith("text/"), "text").otherwise(F.coalesce(by_name, F.when(raw.startswith("%PDF"), "pdf").when(raw.rlike(r"(?i)^\s*<"), "html").otherwise("text")))
    plain = F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?i)<br\s*/?>|</(p|div|tr|li|h\d)\s*>", "\n")
    stripped = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"<[^>]*>", " "), r"[ \t]+", " "), r" ?\n ?", "\n"))
    return kind, F.when(kind == "html", stripped).when(kind == "text", raw)


def by_reader(companies: DataFrame, key: str, readers: dict[str, Callable[[DataFrame], DataFrame]], default: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows read by the reader that is registered for their key's value, those of no value by the default one, or not at all.

    Readers give equal columns. Each sees its own rows only, so the filter reaches its scan.
    """
    parts = [read(companies.filter(F.col(key) == value)) for value, read in readers.items()]
    if default is not None:
        parts.append(default(companies.filter(~F.coalesce(F.col(key).isin(*readers), F.lit(False)))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

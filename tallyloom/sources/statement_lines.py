"""Statements in lines of text: a row by its context, the best parse of a line, grids of periods, sections.

Lines come as (doc, line_i, text). Windows and groups are a document's, so their size does not grow with the number of documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.keys import taxonomy_key
from tallyloom.functions.scalars import closing_quarter, parse_number

#: Points for what stands in a line's context (itself and the twelve lines before), and in the line itself.
IN_CONTEXT = (
    (r"three\s+months\s+ended|three-month period|current quarter", 10), ("截至.*三个月|三个月截至|本季度", 10), (r"six\s+months\s+ended|nine\s+months\s+ended|year\s+ended", -8), ("截至.*六个月|截至.*九个月|截至.*年度|年度", -8),
    (r"share-based\s+compensation|stock-?based\s+compensation", -12), (r"non-gaap|non-ifrs|adjusted|reconciliation|note\s+\d+|附注", -14), (r"condensed\s+consolidated|income\s+statement|unaudited|audited", 8),
    (r"\b(?:q[1-4]\s*20\d{2}|20\d{2}\s*q[1-4]|[1-4]q20\d{2})\b", 4), (r"basic earnings per share|diluted earnings per share|capital expenditure|free cash flow", -12),
)
IN_LINE = ((r"\b(?:yoy|year-on-year|quarter-on-quarter|qoq)\b|margin increased|margin decreased|\bwas\b", -10), (r"(?:^|\s)[—–-](?:\s|$).*?(?:^|\s)[—–-](?:\s|$)", -10))
#: How numbers of periods are said, and months.
SPANS = (("threemonthsended|quarterended", 1), ("sixmonthsended", 2), ("ninemonthsended", 3), ("yearended|twelvemonthsended", 4))
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Marks before a label that number it or refer to a note.
NUMBERING = r"(?:(?:\([^)]{1,80}\)|(?:note|附注)\s*[A-Za-z0-9]*|\(?\d+[A-Za-z]?\)?|\(?[IVXivx]{1,8}\)?)\s+)*"
NUMBER = r"\(?-?\d[\d,]*(?:\.\d+)?\)?%?"
_TOKEN = r"^[$€£¥]?\(?[-−–—]?[$€£¥]?\d[\d,]*(?:\.\d+)?\)?%?$"
_LATER = 1 << 30


def _in_doc() -> Window:
    return Window.partitionBy("doc").orderBy("line_i")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def label_pattern(alias: str) -> str:
    """A line that begins with the alias, numbered or not, in any case; what follows is its group."""
    words = r"\s+".join(re.escape(w) for w in alias.split()).replace(r"\(", r"\(?").replace(r"\)", r"\)?")
    return rf"(?i)^{NUMBERING}{words}(?:\s*[:：]?\s*\(?\d+\)?)?\s+(.+)$"


def _dates(q_ord: Column, years_back: int) -> Column:
    """A pattern of the day that the quarter ends on, some years back."""
    quarter, year = q_ord % 4, F.floor(q_ord / 4) - years_back
    month, day = (quarter + 1) * 3, F.element_at(F.array(*(F.lit(d) for d in (31, 30, 30, 31))), (quarter + 1).cast("int"))
    name = F.element_at(F.array(*(F.lit(m) for m in MONTHS)), month.cast("int"))
    return F.format_string(r"(?i)%s\s+%d,\s*%d|%d\s*[-/]\s*%02d\s*[-/]\s*%02d|%d\s*年\s*%d\s*月\s*%d\s*日", name, day, year, year, month, day, year, month, day)


def best_rows(lines: DataFrame, aliases: dict[str, list[str]], hints: DataFrame | None = None) -> DataFrame:
    """Doc, field, line_i, score, values of each field's best line.

    A line counts if it begins with one of the field's aliases and numbers follow; percentages are no values. With a hint (doc,
    q_ord) lines score by context: fixed points for what it says, 4 for the quarter's last day, 8 for that of a year before; four
    values are worth 10, two 6, three or more 2, fewer -4, each past four -4 (12 at most), a percentage -2. Ties go to fewer
    percentages, nearer to four values, fewer values, the earlier line, the earlier alias. Without a hint the first alias's first
    line counts, with a score of 0.
    """
    matches = [F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("field"), F.lit(i).alias("alias_i"), F.regexp_extract("text", p, 1).alias("rest"))) for f, names in aliases.items() for i, p in enumerate(map(label_pattern, names))]
    context = F.concat_ws(" ", F.collect_list("text").over(_in_doc().rowsBetween(-12, 0)))
    seen = lines.withColumn("context", _squeezed(context)).withColumn("m", F.explode(F.filter(F.array(*matches), lambda x: x.isNotNull()))).select("doc", "line_i", "context", _squeezed(F.col("text")).alias("line"), "m.*")
    seen = seen.withColumn("tokens", F.regexp_extract_all(F.regexp_extract(F.trim("rest"), rf"^(?:\s*{NUMBER})+", 0), F.lit(NUMBER), F.lit(0)))
    numbers = F.filter(F.transform(F.filter("tokens", lambda t: ~t.endswith("%")), parse_number), lambda v: v.isNotNull())
    seen = seen.withColumns({"values": numbers, "percents": F.size(F.filter("tokens", lambda t: t.endswith("%")))}).filter(F.size("values") > 0)
    hinted = seen.join(hints.select("doc", "q_ord"), "doc", "left") if hints is not None else seen.withColumn("q_ord", F.lit(None).cast("long"))
    points = lambda where, told: F.when(F.regexp(where, told), 1).otherwise(0)
    n, score = F.size("values"), F.lit(0)
    for pattern, worth in IN_CONTEXT:
        score = score + points(F.col("context"), F.lit(f"(?i){pattern}")) * worth
    for pattern, worth in IN_LINE:
        score = score + points(F.col("line"), F.lit(f"(?i){pattern}")) * worth
    score = score + points(F.col("context"), _dates(F.col("q_ord"), 0)) * 4 + points(F.col("context"), _dates(F.col("q_ord"), 1)) * 8 - F.when(F.col("percents") > 0, 2).otherwise(0)
    score = score + F.when(n == 4, 10).when(n == 2, 6).when(n >= 3, 2).otherwise(-4) - F.when(n > 4, F.least((n - 4) * 4, F.lit(12))).otherwise(0)
    scored = hinted.withColumn("score", F.when(F.col("q_ord").isNotNull(), score).otherwise(0))
    known = F.col("q_ord").isNotNull()
    rank = F.struct(-F.col("score"), *(F.when(known, x).otherwise(0) for x in (F.col("percents"), F.abs(n - 4), n, F.col("line_i"))), "alias_i", "line_i")
    return scored.groupBy("doc", "field").agg(F.min_by(F.struct("line_i", "score", "values"), rank).alias("b")).select("doc", "field", "b.*")


def _words(c: Column) -> Column:
    return F.filter(F.split(_squeezed(c), " "), lambda w: w != "")


def _is_number(w: Column) -> Column:
    return w.rlike(_TOKEN)


def _count(c: Column) -> Column:
    return F.size(F.filter(_words(c), _is_number))


def clean_label(c: Column) -> Column:
    """A label without numbering, words of adding or taking off, and colons."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(_squeezed(c), r"[:：\s]+$", "")), r"^(?:(?:[一二三四五六七八九十]+|[0-9ivxIVX]+)[、.．:：)]+\s*|(?:加|减|其中)[：:\s]+)+", ""))


def best_parses(lines: DataFrame, aliases: dict[str, list[str]], heads: tuple[str, ...] = ("cost", "opex")) -> DataFrame:
    """Doc, line_i, label, key (normalised), field, values of each line's best parse.

    A line is read by itself; without numbers also joined with the next one and the next two, if that has some; with a single one also
    with the next, if that has some. The label is what stands before the first number. Most values win, then the longer label,
    then the shorter join. Without values a line counts if it ends with a colon or names one of the `heads`, and then stays as it
    is. A field's alias is the label, or begins or ends it; the first field counts.
    """
    after = lines.withColumns({"a": F.coalesce(F.lead("text", 1).over(_in_doc()), F.lit("")), "b": F.coalesce(F.lead("text", 2).over(_in_doc()), F.lit(""))}).withColumn("n", _count(F.col("text")))
    one, two = F.concat_ws(" ", "text", "a"), F.concat_ws(" ", "text", "a", "b")
    joins = F.array(
        F.struct(F.lit(0).alias("i"), F.col("text").alias("t")), F.when(F.when(F.col("n") == 0, _count(one) > 0).otherwise((F.col("n") < 2) & (_count(F.col("a")) > 0)), F.struct(F.lit(1).alias("i"), one.alias("t"))),
        F.when((F.col("n") == 0) & (_count(two) > 0), F.struct(F.lit(2).alias("i"), two.alias("t"))),
    )
    parsed = after.select("doc", "line_i", F.explode(F.filter(joins, lambda x: x.isNotNull())).alias("c")).select("doc", "line_i", "c.i", "c.t", _words(F.col("c.t")).alias("w"))
    first = F.array_min(F.filter(F.transform("w", lambda w, k: F.when(_is_number(w), k)), lambda k: k.isNotNull()))
    parsed = parsed.withColumns({"label": clean_label(F.array_join(F.slice("w", 1, F.coalesce(first, F.size("w"))), " ")), "values": F.filter(F.transform(F.filter("w", _is_number), parse_number), lambda v: v.isNotNull())})
    parsed = parsed.withColumn("key", taxonomy_key("label")).filter(F.col("label") != "")
    named = lambda keys: F.exists(F.array(*(F.lit(k) for k in keys)), lambda k: F.col("key").startswith(k) | F.col("key").endswith(k))
    plain = {f: [re.sub("[^a-z0-9一-鿿]", "", a.lower()) for a in names] for f, names in aliases.items()}
    parsed = parsed.withColumn("field", F.coalesce(*(F.when((F.col("key") != "") & named(keys), F.lit(f)) for f, keys in plain.items()), F.lit(None).cast("string")))
    head = F.coalesce(F.col("field").isin(*heads), F.lit(False))
    parsed = parsed.filter((F.size("values") > 0) | F.trim("t").endswith(":") | head)
    stays = (F.size("values") == 0) & head
    rank = F.struct((~stays).cast("int"), F.when(stays, F.col("i")).otherwise(0), -F.size("values"), -F.length("label"), "i")
    return parsed.groupBy("doc", "line_i").agg(F.min_by(F.struct("label", "key", "field", "values"), rank).alias("p")).select("doc", "line_i", "p.*")


def _period(q_ord: Column, span: Column) -> Column:
    return F.struct(q_ord.cast("long").alias("q_ord"), span.cast("int").alias("span"))


def _named_quarters(line: Column) -> Column:
    """Periods of a line that names quarters: Q1 2024, 1Q24, 2024Q1."""
    full = lambda y: F.when(y < 100, y + 2000).otherwise(y)

    def found(pattern: str, year: int, quarter: int) -> Column:
        get = lambda x, i: F.regexp_extract(x, pattern, i).try_cast("long")
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda x: _period(full(get(x, year)) * 4 + get(x, quarter) - 1, F.lit(1)))

    return F.concat(found(r"\bQ([1-4])\s+(\d{4})\b", 2, 1), found(r"(?i)\b([1-4])Q\s*[-/']?(\d{4}|\d{2})\b", 2, 1), found(r"(?i)\b(\d{4})\s*Q([1-4])\b", 1, 2))


_DAY = rf"(?i)({'|'.join(MONTHS)})\s+(\d{{1,2}})"


def _date(text: Column, year: Column) -> Column:
    """The first day in a text, in a year."""
    month = F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), F.lower(F.substring(F.regexp_extract(text, _DAY, 1), 1, 3)))
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), F.regexp_extract(text, _DAY, 2)), "yyyy-M-d")


def _years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("long"))


def _span(text: Column) -> Column:
    key, out = taxonomy_key(text), F.lit(None).cast("int")
    for pattern, n in reversed(SPANS):
        out = F.when(key.rlike(pattern), n).otherwise(out)
    return out


def period_context(texts: DataFrame) -> DataFrame:
    """K3: doc, q_ord and kind (quarterly, half-year, annual) of a Chinese report (doc, text) by its title; others have none."""
    get = lambda p, i: F.regexp_extract("text", p, i)
    year = get(r"(\d{4})\s*年", 1).try_cast("long")
    numbers = F.create_map(*(F.lit(x) for pair in {"一": 1, "二": 2, "三": 3, "四": 4, "1": 1, "2": 2, "3": 3, "4": 4}.items() for x in pair))
    quarter = F.try_element_at(numbers, F.regexp_extract("text", r"(\d{4})\s*年\s*第?\s*([一二三四1-4])\s*季度报告", 2))
    of_year = lambda p: F.regexp("text", F.concat(F.col("_y").cast("string"), F.lit(p)))
    told = texts.withColumn("_y", year).filter(F.col("_y").isNotNull())
    kind = F.when(of_year(r"\s*年\s*第?\s*[一二三四1-4]\s*季度报告"), "quarterly").when(of_year(r"\s*年\s*半年度报告"), "half-year").when(of_year(r"\s*年\s*年度报告"), "annual")
    at = F.when(F.col("kind") == "quarterly", quarter).when(F.col("kind") == "half-year", 2).otherwise(4)
    return told.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("doc", (F.col("_y") * 4 + at - 1).cast("long").alias("q_ord"), "kind")


def period_columns(lines: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """K2, K3: doc and columns, an array of (q_ord, span), from a statement's first lines: the first kind of header that it has.

    Cells behind bars: spans in a row, days and years in it and the three rows below, years dealt to the spans in order. Named
    quarters in the first twelve lines. A span with a day beside it (same or next line) and the first two years of four lines.
    Chinese headers of the first 24 lines: 截至…止…个月期间, or months that make a quarter. Income statements of a Chinese report (contexts: doc,
    q_ord) from the year's start to its end: that span this year and the year before.
    """
    head = lines.filter(F.col("line_i") < 40).select("doc", "line_i", "text", _span(F.col("text")).alias("span"), _years(F.col("text")).alias("years"))
    found = [_behind_bars(head), _of_lines(head, 12, _named_quarters(F.col("text"))), _spanned(head), *_chinese(head)]
    if contexts is not None:
        found.append(_cumulative(head, contexts))
    ranked = None
    for i, periods in enumerate(found):
        one = periods.select("doc", F.struct(F.lit(i).alias("i"), "columns").alias("c")).filter(F.size("c.columns") > 0)
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("doc").agg(F.min_by("c.columns", "c.i").alias("columns"))


def _in_order(df: DataFrame, period: Column, *place: str) -> DataFrame:
    """doc and columns: the periods of each document in order of their places, each once."""
    cells = df.withColumn("p", period).filter(F.col("p.q_ord").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct(*place, "p")))
    return cells.groupBy("doc").agg(listed.alias("l")).select("doc", F.array_distinct(F.transform("l", lambda x: x["p"])).alias("columns"))


def _of_lines(head: DataFrame, n: int, periods: Column) -> DataFrame:
    each = head.filter(F.col("line_i") < n).select("doc", "line_i", F.posexplode(periods).alias("k", "found"))
    return _in_order(each, F.col("found"), "line_i", "k")


def _behind_bars(head: DataFrame) -> DataFrame:
    """The first row of cells with spans, and days and years of it and of the three rows below; years are dealt to spans in order."""
    doc = Window.partitionBy("doc")
    rows = head.filter((F.col("line_i") < 16) & F.col("text").contains("|")).withColumn("row", F.row_number().over(doc.orderBy("line_i")))
    cells = rows.select("doc", "row", F.posexplode(F.split("text", r"\|")).alias("cell_i", "cell")).withColumn("span", _span(F.col("cell")))
    near = cells.withColumn("_first", F.min(F.when(F.col("span").isNotNull(), F.col("row"))).over(doc)).filter((F.col("row") >= F.col("_first")) & (F.col("row") < F.col("_first") + 4))
    near = near.withColumns({"years": _years(F.col("cell")), "days": F.regexp_extract_all("cell", F.lit(_DAY), F.lit(0))})
    listed = lambda c, when: F.array_sort(F.collect_list(F.when(when, F.struct("row", "cell_i", c))))
    docs = near.groupBy("doc").agg(listed("span", (F.col("row") == F.col("_first")) & F.col("span").isNotNull()).alias("spans"), listed("years", F.size("years") > 0).alias("years"), listed("days", F.size("days") > 0).alias("days"))
    docs = docs.select("doc", "spans.span", F.flatten("years.years").alias("years"), F.flatten("days.days").alias("days"))
    n, m = F.size("years"), F.size("span")
    each = docs.filter((m > 0) & (n >= m) & (F.size("days") > 0)).withColumns({"base": F.floor(n / m), "plain": m - n % m}).select("*", F.posexplode("years").alias("k", "year"))
    # what doesn't divide goes to the last spans
    early = F.col("k") < F.col("plain") * F.col("base")
    owner = F.when(early, F.floor(F.col("k") / F.col("base"))).otherwise(F.col("plain") + F.floor((F.col("k") - F.col("plain") * F.col("base")) / (F.col("base") + 1))).cast("int")
    told = each.withColumn("owner", owner).withColumn("day", F.get("days", F.least("owner", F.size("days") - 1))).withColumn("date", _date(F.col("day"), F.col("year")))
    return _in_order(told, _period(closing_quarter(F.col("date")), F.get("span", F.col("owner"))), "k")


def _spanned(head: DataFrame) -> DataFrame:
    """The first line with a span that has a day in it or the next line, and years in it or the three next: the first two."""
    after = lambda c, i: F.lead(c, i).over(_in_doc())
    near = head.withColumns({"day": F.concat_ws(" ", "text", after("text", 1)), "ys": F.slice(F.concat("years", *(F.coalesce(after("years", i), F.array().cast("array<bigint>")) for i in (1, 2, 3))), 1, 2)})
    each = near.filter((F.col("line_i") < 12) & F.col("span").isNotNull()).select("doc", "line_i", "span", "day", F.posexplode("ys").alias("k", "year"))
    told = each.withColumn("date", _date(F.col("day"), F.col("year"))).withColumn("p", _period(closing_quarter(F.col("date")), F.col("span"))).filter(F.col("p.q_ord").isNotNull())
    first = told.withColumn("_first", F.min("line_i").over(Window.partitionBy("doc"))).filter(F.col("line_i") == F.col("_first"))
    return _in_order(first, F.col("p"), "k")


def _chinese(head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Periods by 截至…止…个月期间, and by months that make a quarter, anywhere in the first 24 lines."""
    texts = head.filter(F.col("line_i") < 24).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_i", "text"))), lambda x: x["text"]), " ").alias("text"))
    until, months = r"截至\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日止\s*(12|[369]|十二|三|六|九)\s*个月期间", r"(\d{4})\s*年\s*(\d{1,2})\s*[-至]\s*(\d{1,2})\s*月"
    eastern = F.create_map(*(F.lit(x) for pair in {"3": 1, "三": 1, "6": 2, "六": 2, "9": 3, "九": 3, "12": 4, "十二": 4}.items() for x in pair))
    each = lambda p: texts.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("k", "x"))
    get = lambda p, i: F.regexp_extract("x", p, i).try_cast("long")
    ended = _period(get(until, 1) * 4 + F.floor((get(until, 2) - 1) / 3), F.try_element_at(eastern, F.regexp_extract("x", until, 4)))
    quarter = (get(months, 3) - get(months, 2) == 2) & (get(months, 3) % 3 == 0)
    return _in_order(each(until), ended, "k"), _in_order(each(months), _period(F.when(quarter, get(months, 1) * 4 + get(months, 3) / 3 - 1), F.lit(1)), "k")


def _cumulative(head: DataFrame, contexts: DataFrame) -> DataFrame:
    """K3: of an income statement from the year's start to the end of a report's quarter: that span, and that of a year before."""
    has = lambda p: F.max(F.col("text").rlike(p))
    docs = head.groupBy("doc").agg((has("利润表|损益表") & has("年初到报告期末|年初至报告期末|本期发生额")).alias("_is")).filter("_is").join(contexts.select("doc", "q_ord"), "doc")
    return docs.select("doc", F.array(*(_period(F.col("q_ord") - 4 * k, F.col("q_ord") % 4 + 1) for k in (0, 1))).alias("columns"))


def scale_of(values: Column) -> Column:
    """K2: what a statement's unit is worth, by its largest revenue: thousands from 100,000 on, millions from 100 on."""
    largest = F.array_max(F.transform(values, F.abs))
    return F.when(largest >= 100_000, 1_000.0).when(largest >= 100, 1_000_000.0).otherwise(1.0)


def statement_entries(lines: DataFrame, aliases: dict[str, list[str]], expenses: tuple[str, ...] = ("cost", "opex", "tax"), contexts: DataFrame | None = None) -> DataFrame:
    """K2: doc, q_ord, span, field, value (in units of one) of a statement's lines: each field's first row with a value for each column.

    A whole number of up to 999 before the values is a note's, if those exceed it a hundredfold and ten thousand. Expenses are
    positive. The unit follows from revenue.
    """
    columns = period_columns(lines, contexts)
    n = F.size("columns")
    rows = best_parses(lines, aliases).filter(F.col("field").isNotNull()).join(columns, "doc").filter(F.size("values") >= n)
    first, rest = F.col("values")[0], F.slice("values", F.lit(2), n)
    note = (F.size("values") > n) & (first == F.floor(first)) & first.between(0, 999) & (F.array_max(F.transform(rest, F.abs)) > F.greatest(F.abs(first) * 100, F.lit(10_000.0)))
    picked = rows.withColumn("values", F.when(note, rest).otherwise(F.slice("values", F.lit(1), n)))
    chosen = picked.groupBy("doc", "field").agg(F.min_by(F.struct("columns", "values"), "line_i").alias("r")).select("doc", "field", "r.*")
    unit = F.max(F.when(F.col("field") == "revenue", scale_of(F.col("values")))).over(Window.partitionBy("doc"))
    each = chosen.withColumn("unit", F.coalesce(unit, F.lit(1.0))).select("doc", "field", "unit", F.posexplode("columns").alias("i", "c"), "values")
    value = F.get("values", F.col("i")) * F.col("unit")
    return each.select("doc", "c.q_ord", "c.span", "field", F.when(F.col("field").isin(*expenses), F.abs(value)).otherwise(value).alias("value"))


def section_rows(parses: DataFrame, headers: tuple[str, ...], totals: tuple[str, ...], stops: tuple[str, ...], least: int = 1) -> DataFrame:
    """K2: doc, line_i, label, values of a section's detail rows, of best_parses' rows.

    The section starts at its last header (a key of `headers`, without values) before the first total behind the first header,
    and ends at a total (a key of `totals`) or at a field of `stops`. Details have `least` values or more, aren't totals, and
    come once a label.
    """
    doc = Window.partitionBy("doc")
    header, end = F.col("key").isin(*headers) & (F.size("values") == 0), F.col("key").isin(*totals)
    first = lambda when: F.min(F.when(when, F.col("line_i"))).over(doc)
    rows = parses.withColumn("_head", first(header)).withColumn("_total", F.coalesce(first(end & (F.col("line_i") > F.col("_head"))), F.lit(_LATER)))
    rows = rows.withColumn("_start", F.max(F.when(header & (F.col("line_i") < F.col("_total")), F.col("line_i"))).over(doc))
    rows = rows.withColumn("_stop", F.coalesce(first((end | F.coalesce(F.col("field").isin(*stops), F.lit(False))) & (F.col("line_i") > F.col("_start"))), F.lit(_LATER)))
    inside = rows.filter((F.col("line_i") > F.col("_start")) & (F.col("line_i") < F.col("_stop")) & (F.size("values") >= least) & ~F.col("key").startswith("total") & ~F.col("key").isin(*headers))
    return inside.groupBy("doc", "key").agg(F.min_by(F.struct("line_i", "label", "values"), "line_i").alias("r")).select("doc", "r.*")


def url_rank(url: Column, number: str | None = None) -> Column:
    """How likely a file is the quarter's results, the least first: kind, latest year, latest quarter, pdf, address.

    `number` is the pattern of a site's own numbers of files, in which no year or quarter is looked for.
    """
    low = F.lower(F.trim(url))
    dated = low if number is None else F.regexp_replace(low, number, "")
    has = lambda p: F.when(low.rlike(p), 1).otherwise(0)
    kind = F.when(low.rlike("result|earn|quarter|financial-supplement|supplement|stat-book"), 0).when(low.rlike("release|financial"), 1).otherwise(2)
    kind = kind + 4 * has("transcript|presentation|slides|roadshow|webcast|overview|policy|codeconduct") + 2 * has(r"/[0-9a-f]{8}-[0-9a-f-]{27,}\.pdf(?:\?|$)") + 3 * has(r"proxy|annual-report|annual\+report|presentation|icr|conference|webcast")
    latest = lambda p: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(dated, F.lit(p), F.lit(1)), lambda x: x.cast("int"))), F.lit(0))
    return F.struct(kind.alias("kind"), (-latest(r"\b(20\d{2})\b")).alias("year"), (-latest(r"\bq([1-4])\b")).alias("quarter"), F.when(low.endswith(".pdf") | low.contains(".pdf?"), 0).otherwise(1).alias("other"), url.alias("url"))

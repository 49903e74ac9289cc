"""Text of statements: wrapped lines, sections, display formats, error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A line that holds a number at its end or before a space is whole; the symbols of currencies.
WHOLE_LINE = r"\(?-?\d[\d,]*(?:\.\d+)?\)?%?(?:\s|$)"
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "HKD": "HK$", "KRW": "₩", "TWD": "NT$", "CAD": "C$"}


def lines(text: Column) -> Column:
    """A text's lines with white space collapsed; empty ones go."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(each, lambda x: x != "")


def whole_lines(text: Column) -> Column:
    """Lines, where one without a number is joined by a space with those that follow, up to the first with a number."""

    def step(done: Column, line: Column) -> Column:
        # the state's last element is the line that is still open, empty if none is
        open_line, closed = F.element_at(done, -1), F.slice(done, 1, F.size(done) - 1)
        joined = F.trim(F.concat_ws(" ", open_line, line))
        return F.concat(closed, F.when(line.rlike(WHOLE_LINE), F.array(joined, F.lit(""))).otherwise(F.array(joined)))

    return F.aggregate(lines(text), F.array(F.lit("")), step, lambda done: F.filter(done, lambda x: x != ""))


def section(text: Column, starts: list[str], ends: list[str]) -> Column:
    """The text from the earliest match of any start pattern up to the earliest match of any end pattern behind its first character;
    the whole text if nothing starts it. Letters' case does not count."""
    source = F.coalesce(text, F.lit(""))
    either = lambda patterns: "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    begin = F.regexp_instr(source, F.lit(either(starts)))
    rest = F.substr(source, begin, F.length(source))
    stop = F.regexp_instr(F.substr(rest, F.lit(2), F.length(rest)), F.lit(either(ends))) if ends else F.lit(0)
    cut = F.when(stop > 0, F.substr(rest, F.lit(1), stop)).otherwise(rest)
    return F.when(begin > 0, cut).otherwise(source)


def _one_digit(value: Column) -> Column:
    return F.round(value, 1).cast("decimal(20,1)").cast("string")


def money_label(value: Column, currency: Column, wrap: bool = False) -> Column:
    """Billions with one digit behind the currency's symbol (or its code and a space); negatives in parentheses if `wrap`, else
    without sign; "-" for null."""
    code = F.upper(F.coalesce(currency, F.lit("USD")))
    known = F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))
    label = F.concat(F.coalesce(F.try_element_at(known, code), F.concat(code, F.lit(" "))), _one_digit(F.abs(value)), F.lit("B"))
    shown = F.when(value < 0, F.concat(F.lit("("), label, F.lit(")"))).otherwise(label) if wrap else label
    return F.coalesce(shown, F.lit("-"))


def percent_label(value: Column, signed: bool = False, compact: bool = False) -> Column:
    """A percentage with one digit, without it where whole if `compact`, with a plus from zero on if `signed`; "-" for null."""
    digits = _one_digit(value)
    shown = F.regexp_replace(digits, r"\.0$", "") if compact else digits
    sign = F.when(value >= 0, "+").otherwise("") if signed else F.lit("")
    return F.coalesce(F.concat(sign, shown, F.lit("%")), F.lit("-"))


def points_label(value: Column, metric: str) -> Column:
    """A change in percentage points behind the metric's name; empty for null."""
    sign = F.when(value >= 0, "+").otherwise("")
    return F.coalesce(F.concat(F.lit(f"{metric} "), sign, F.regexp_replace(_one_digit(value), r"\.0$", ""), F.lit("pp")), F.lit(""))


def error_details(details: Column, layer: str, source: str, phase: str = "", severity: str = "error") -> Column:
    """C17: details (message, error, severity, layer, source, phase, kind, type) with trimmed messages and missing fields filled; those
    without any message go. The result has message, severity, layer, source, phase, kind."""
    filled = lambda c, other: F.coalesce(F.when(c != "", c), F.when(F.lit(other) != "", F.lit(other)))
    plain = F.transform(
        F.coalesce(details, F.array()),
        lambda d: F.struct(
            F.trim(F.coalesce(F.when(d["message"] != "", d["message"]), d["error"], F.lit(""))).alias("message"),
            filled(d["severity"], severity).alias("severity"), filled(d["layer"], layer).alias("layer"),
            filled(d["source"], source).alias("source"), filled(d["phase"], phase).alias("phase"),
            F.coalesce(d["kind"], F.when(d["type"] != "", d["type"])).alias("kind"),
        ),
    )
    return F.filter(plain, lambda d: d["message"] != "")


def error_bundle(errors: Column, details: Column, layer: str, source: str) -> tuple[Column, Column]:
    """C17: messages and details, of which either is made from the other where it is missing."""
    told = F.filter(F.transform(F.coalesce(errors, F.array().cast("array<string>")), lambda e: F.trim(e)), lambda e: e != "")
    known = error_details(details, layer, source)
    null = F.lit(None).cast("string")
    made = F.transform(told, lambda e: F.struct(e.alias("message"), F.lit("error").alias("severity"), F.lit(layer).alias("layer"), F.lit(source).alias("source"), null.alias("phase"), null.alias("kind")))
    return F.when(F.size(told) > 0, told).otherwise(F.transform(known, lambda d: d["message"])), F.when(F.size(known) > 0, known).otherwise(made)


def joined_cells(text: Column) -> Column:
    """K7: lines of cells, where one that begins with an empty cell and holds two numbers or more goes on the line of cells before it."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")

    def step(done: Column, line: Column) -> Column:
        goes_on = line.startswith("|") & (F.size(F.filter(cells(line), lambda c: c.rlike(r"\d"))) >= 2) & (F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1)).contains("|"), F.lit(False))
        longer = F.concat(F.try_element_at(done, F.lit(-1)), F.lit(" | "), F.array_join(cells(line), " | "))
        return F.when(goes_on, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(lines(text), F.array().cast("array<string>"), step)

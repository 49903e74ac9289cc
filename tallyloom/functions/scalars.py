"""Numbers in text, quarters, tolerances, scales, languages, labels, trading days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.keys import taxonomy_key


def parse_number(c: Column) -> Column:
    """A number with thousands commas, percent sign, any dash or accounting brackets; null where none is left.

    Letters that stand alone (footnote marks) go first, then all that no number holds.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[−–—]", "-"), r"\b[a-zA-Z]\b", " "), r"[^0-9().\-]+", "")
    value = F.regexp_replace(bare, r"^[()]+|[()]+$", "").try_cast("double")
    return F.when(bare.startswith("(") & bare.endswith(")"), -value).otherwise(value)


def quarter_label(q_ord: Column) -> Column:
    """2024Q3 for 8098."""
    return F.concat(F.floor(q_ord / 4).cast("string"), F.lit("Q"), (q_ord % 4 + 1).cast("string"))


def quarter_ordinal(label: Column) -> Column:
    """8098 for 2024Q3; null for any other text."""
    year, quarter = (F.regexp_extract(label, r"^(\d{4})Q([1-4])$", i).try_cast("long") for i in (1, 2))
    return year * 4 + quarter - 1


def period_end(q_ord: Column) -> Column:
    """The last day of the quarter."""
    return F.last_day(F.make_date(F.floor(q_ord / 4).cast("int"), (q_ord % 4 * 3 + 3).cast("int"), F.lit(1)))


def quarter_window(q_ord: Column, span: int) -> Column:
    """The `span` quarters that end with this one."""
    return F.sequence(q_ord - (span - 1), q_ord)


def closing_quarter(day: Column, grace: int = 7) -> Column:
    """The quarter a period ended in; the first `grace` days after a quarter still close it (52 and 53 week years)."""
    early = (F.month(day) % 3 == 1) & (F.dayofmonth(day) <= grace)
    at = F.when(early, F.date_sub(day, grace)).otherwise(day)
    return (F.year(at) * 4 + F.quarter(at) - 1).cast("long")


def fiscal_quarter_end(year: Column, quarter: Column, month: Column, day: Column) -> Column:
    """Where a fiscal quarter ends if the fiscal year ends on (month, day); days past the month's end mean its last day."""
    end = F.add_months(F.make_date(year, month, F.lit(1)), -3 * (4 - quarter))
    return F.date_add(end, F.least(day, F.dayofmonth(F.last_day(end))) - 1)


def to_billions(value: Column, scale: Column | float = 1.0) -> Column:
    """Units of `scale` as billions, 3 digits."""
    return F.round(value * scale / 1e9, 3)


def scale_of_text(c: Column) -> Column:
    """The unit a header names, the larger one if several; 1 if none."""
    low = F.lower(c)
    return F.when(low.contains("billions"), 1e9).when(low.contains("millions"), 1e6).when(low.contains("thousands"), 1e3).otherwise(1.0)


def scale_of_size(most: Column, named: Column | float = 1.0) -> Column:
    """Where no unit is named, the one the largest revenue suggests."""
    named = F.lit(named) if not isinstance(named, Column) else named
    return F.when((named != 1) | most.isNull(), named).when(F.abs(most) >= 100_000, 1e3).when(F.abs(most) >= 100, 1e6).otherwise(1.0)


def percent(part: Column, whole: Column) -> Column:
    """C11: 100 * part / whole, 3 digits; null where the whole is 0."""
    return F.round(F.try_divide(part, whole) * 100, 3)


def tolerance(value: Column, least: float = 0.12) -> Column:
    """C11: 3 per cent of the value, at least 0.12 (money) or 0.35 (rates)."""
    return F.greatest(F.lit(least), F.abs(F.coalesce(value, F.lit(0.0))) * 0.03)


def language_profile(c: Column) -> Column:
    """Zh, en, mixed or unknown by the share of Han among Han and Latin letters of the whole text."""
    han, latin = F.regexp_count(c, F.lit("[一-鿿]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = F.try_divide(han, han + latin)
    return F.when(share > 0.85, "zh").when((share >= 0.15) & (latin > 0), "mixed").when(share.isNotNull(), "en").otherwise("unknown")


def iso_date(c: Column) -> Column:
    """A strict yyyy-mm-dd date, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def slug(c: Column) -> Column:
    """Lower case words joined by hyphens; company if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "company").otherwise(F.coalesce(made, F.lit("company")))


def ticker(c: Column) -> Column:
    """Upper case letters and digits."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


#: How camel-case member names become labels, in this order.
LABEL_RULES = (
    ("(Member|Segment)$", ""),
    ("([A-Za-z])and([A-Z])", "$1And$2"),
    ("ThreeSixFive", "365"),
    ("([a-z0-9])([A-Z])", "$1 $2"),
    ("([A-Z]+)([A-Z][a-z])", "$1 $2"),
    (" And ", " & "),
    (r"\bUs\b", "US"),
    (r"\bUk\b", "UK"),
    (r"\bIot\b", "IoT"),
    (r"\bAi\b", "AI"),
    (r"\bI Phone\b", "iPhone"),
    (r"\bI Pad\b", "iPad"),
    (r"\s+", " "),
)


def member_label(c: Column) -> Column:
    """A label from a camel-case member name; the name itself if nothing is left."""
    label = c
    for pattern, to in LABEL_RULES:
        label = F.regexp_replace(label, pattern, to)
    label = F.trim(label)
    low = F.lower(c)
    return F.when(low == "servicemember", "Services").when(low == "productmember", "Products").when(label == "", c).otherwise(label)


#: Words a signature leaves out, and words that keep their s.
SIGNATURE_STOP = ("and", "seg", "segment", "segments", "member", "service", "services")
SIGNATURE_KEEP_S = ("news", "this", "us")


def signature(c: Column) -> Column:
    """A label's different words but the stop words, four and five letters long ones without their s, in order, joined by |."""
    words = F.split(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*SIGNATURE_STOP))
    plain = F.transform(kept, lambda w: F.when(F.length(w).isin(4, 5) & w.endswith("s") & ~w.isin(*SIGNATURE_KEEP_S), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_join(F.array_sort(F.array_distinct(plain)), "|")


def axis_step(most: Column, lines: int = 6) -> Column:
    """A step of 1, 2, 5 or 10 times a power of ten for about `lines` grid lines."""
    rough = most / max(lines, 1)
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    unit = rough / power
    step = F.when(unit < 1.5, 1).when(unit < 3, 2).when(unit < 7, 5).otherwise(10) * power
    return F.when(most > 0, step).otherwise(1.0)


def is_money_unit(c: Column) -> Column:
    """B2: a currency code of three capitals."""
    return c.rlike("^[A-Z]{3}$")


#: Segment revenue concepts and their priority, best first.
CONCEPT_PRIORITY = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": 120,
    "RevenueFromContractWithCustomerIncludingAssessedTax": 118,
    "RevenuesNetOfInterestExpense": 116,
    "RevenuesNetOfInterestExpenseFullTaxEquivalentBasis": 116,
    "NetRevenues": 114,
    "SalesRevenueNet": 112,
    "SalesRevenueServicesNet": 110,
    "SalesRevenueGoodsNet": 109,
    "Revenues": 108,
    "Revenue": 106,
    "OperatingRevenue": 104,
    "OperatingRevenueNet": 102,
    "TotalRevenue": 100,
    "NetSales": 98,
}


def concept_priority(c: Column) -> Column:
    """B2: the concept's priority; 70 for any other that ends in revenue or revenues; -1 rejects."""
    known = F.create_map(*(F.lit(x) for pair in CONCEPT_PRIORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(known, c), F.when(F.lower(c).rlike("revenues?$"), 70).otherwise(-1))


#: A breakdown row whose label holds one of these is no part of a whole.
REJECT_TOKENS = ("total", "subtotal", "operatingincome", "pretaxincome", "incomebeforetax", "netincome", "earningspershare", "dilutedeps", "basiceps", "dividendsdeclared", "weightedaverage", "sharesoutstanding")


def rejected(*texts: Column) -> Column:
    """Whether any of the texts holds a reject token once normalised; nulls hold none."""
    return F.exists(F.array(*texts), lambda t: F.coalesce(taxonomy_key(t).rlike("|".join(REJECT_TOKENS)), F.lit(False)))


def _observed(year: Column, month: int, day: int) -> Column:
    at = F.make_date(year, F.lit(month), F.lit(day))
    return F.date_add(at, F.when(F.weekday(at) == 5, -1).when(F.weekday(at) == 6, 1).otherwise(0))


def _nth(year: Column, month: int, name: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), name), 7 * (n - 1))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: days after 28 March from the age of the moon and the weekday."""
    div = lambda a, b: F.floor(a / b)
    golden, century = year % 19, div(year, 100)
    moon = (century - div(century, 4) - div(8 * century + 13, 25) + 19 * golden + 15) % 30
    full = moon - div(moon, 28) * (1 - div(F.lit(29), moon + 1) * div(21 - golden, 11))
    weekday = (year + div(year, 4) + full + 2 - century + div(century, 4)) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (full - weekday).cast("int"))


def trading_holidays(year: Column) -> Column:
    """The ten market holidays of a year; fixed days at a weekend are observed beside it, even if that is the year before."""
    spring = F.make_date(year, F.lit(5), F.lit(31))
    return F.array(_observed(year, 1, 1), _nth(year, 1, "Mon", 3), _nth(year, 2, "Mon", 3), F.date_sub(easter(year), 2), F.next_day(F.date_sub(spring, 7), "Mon"), _observed(year, 6, 19), _observed(year, 7, 4), _nth(year, 9, "Mon", 1), _nth(year, 11, "Thu", 4), _observed(year, 12, 25))


def is_trading_day(day: Column) -> Column:
    """A weekday that is no market holiday."""
    return (F.weekday(day) < 5) & ~F.array_contains(trading_holidays(F.year(day)), day)


def refresh_due(ts: Column, hour: int = 17) -> Column:
    """Whether a UTC time is the full hour after the close in New York on a trading day."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    return is_trading_day(F.to_date(local)) & (F.hour(local) == hour) & (F.minute(local) == 0)

"""Money in listing texts. Every function takes and returns a Column and stays in generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.once import once

#: Fixed patterns.
PRICE = r"\$[\d,]+(?:\.\d{2})?"
REVENUE = (r"revenue[:\s]*\$?([\d,]+)", r"gross sales[:\s]*\$?([\d,]+)", r"annual sales[:\s]*\$?([\d,]+)", r"sales[:\s]*\$?([\d,]+)")
CASH_FLOW = (r"cash flow[:\s]*\$?([\d,]+)", r"net income[:\s]*\$?([\d,]+)", r"ebitda[:\s]*\$?([\d,]+)", r"sde[:\s]*\$?([\d,]+)", r"owner benefit[:\s]*\$?([\d,]+)")
NO_PRICE = r"CONTACT|CALL|TBD|N/A|NEGOTIABLE|UPON REQUEST"
#: A number with or without a unit, and perhaps a second one after a dash or the word to. Text is in lower case without dollar signs and commas.
RANGE = r"(\d+(?:\.\d+)?)\s*([km]?)(?:\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)\s*([km]?))?"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A plain decimal number as double, else null; inf, nan, digits with underscores and type suffixes are null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def whole_price(text: Column) -> Column:
    """Digits, commas, dollar signs only; K and M are not understood."""
    return once(F.translate(text, ",$", ""), number).try_cast("bigint")


def any_price(text: Column) -> Column:
    """The first number of a text; K or M anywhere scale it, phrases that hide a price give null."""
    up = F.upper(text)
    first = F.regexp_extract(F.regexp_replace(up, "[$,]", ""), r"[\d.]+", 0)
    scale = F.when(up.contains("M"), 1e6).when(up.contains("K"), 1e3).otherwise(1.0)
    return F.when(~up.rlike(NO_PRICE), (number(first) * scale).try_cast("bigint"))


def scaled_money(text: Column) -> Column:
    """A number with an optional k or m; any other residue gives null."""
    low = F.lower(F.regexp_replace(text, "[$,]", ""))
    return F.when(low.contains("k"), number(F.replace(low, F.lit("k"), F.lit(""))) * 1e3).when(low.contains("m"), number(F.replace(low, F.lit("m"), F.lit(""))) * 1e6).otherwise(number(low))


def first_number(text: Column) -> Column:
    return number(F.replace(F.regexp_extract(text, r"[\d,.]+", 0), F.lit(","), F.lit("")))


def max_price_text(text: Column) -> Column:
    """The price of the largest (value, text) among all of a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PRICE), F.lit(0)), lambda m: F.struct(number(F.regexp_replace(m, "[$,]", "")).alias("v"), m.alias("m")))
    return F.array_max(F.filter(found, lambda s: s.v.isNotNull())).m


def price_range(text: Column) -> Column:
    """Struct of the lower and upper bound of a price text such as ``$100,000 - $250K`` or ``90 to 120k``. A text with one price has it
    as both. A first number without a K or M takes the second one's, unless it is the larger number of the two. Null without a number."""
    unit = lambda c: F.when(c == "m", 1e6).when(c == "k", 1e3).otherwise(1.0)

    def bounds(m: Column) -> Column:
        lifted = (m.low_unit == "") & (m.low <= m.high)
        first = m.low * F.when(lifted, unit(m.high_unit)).otherwise(unit(m.low_unit))
        last = F.coalesce(m.high * unit(m.high_unit), first)
        return F.when(first.isNotNull(), F.struct(F.least(first, last).alias("low"), F.greatest(first, last).alias("high")))

    def parts(low: Column) -> Column:
        part = lambda k: F.regexp_extract(low, RANGE, k)
        return F.struct(number(part(1)).alias("low"), part(2).alias("low_unit"), number(part(3)).alias("high"), part(4).alias("high_unit"))

    return once(F.lower(F.translate(text, ",$", "")), lambda low: once(parts(low), bounds))


def first_above(text: Column, patterns: tuple[str, ...], least: float) -> Column:
    """The first pattern's first amount that is above ``least``; else the next pattern's."""
    word = lambda p: p.split("[", 1)[0]  # noqa: E731  what a pattern begins with: a plain search for it comes first
    value = lambda low, p: once(F.replace(F.regexp_extract(low, p, 1), F.lit(","), F.lit("")), number)
    above = lambda low, p: once(F.when(low.contains(word(p)), value(low, p)), lambda v: F.when(v > least, v))
    return once(F.lower(text), lambda low: F.coalesce(*(above(low, p) for p in patterns)))


def revenue(text: Column) -> Column:
    return first_above(text, REVENUE, 10_000)


def cash_flow(text: Column) -> Column:
    return first_above(text, CASH_FLOW, 1_000)

"""Column functions: arithmetic that keeps missing values missing, text keys, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: coefficients of the Chebyshev fit to erfc, constant term first
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: fixed values: legal suffixes that end a company's name
LEGAL_SUFFIXES = ("ltd", "limited", "plc", "inc", "incorporated", "corp", "corporation", "company", "co", "the")
#: fixed values: units of money in crore
UNITS = {"ABSOLUTE": 1e-7, "THOUSAND": 1e-4, "LAKH": 1e-2, "MILLION": 1e-1, "CRORE": 1.0, "BILLION": 1e2}


def safe_divide(num: Column, den: Column, negative: bool = False) -> Column:
    """num / den where den is positive (with ``negative``: not zero); NULL otherwise."""
    return F.when(den != 0 if negative else den > 0, F.try_divide(num, den))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it, in lambdas too (where Spark works out an expression anew for every element)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def no_nan(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function (error below 1e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normalise_text(x: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def strip_legal_suffix(x: Column) -> Column:
    """A normalised name without legal suffixes at its end and ``the`` at its start."""
    ended = F.regexp_replace(F.concat(F.lit(" "), x), f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")
    return F.trim(F.regexp_replace(F.trim(ended), "^(the( |$))+", ""))


def content_hash(x: Column) -> Column:
    return F.substring(F.sha1(normalise_text(x)), 1, 16)


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude; 0 if both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), None).when(top == 0, 0.0).otherwise(F.abs(a - b) / top)


def to_crore(amount: Column, unit: Column) -> Column:
    """Money in crore. An unknown or missing unit fails: no amount is right without it."""
    return amount * unit_rate(unit, F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("NULL")))).cast("double"))


def unit_rate(unit: Column, unknown: Column | None = None) -> Column:
    """What a unit is in crore; ``unknown`` (NULL) for any other."""
    rate = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.when(unit.isin(list(UNITS)), rate[unit]).otherwise(F.lit(None).cast("double") if unknown is None else unknown)


def fiscal_year(day: Column) -> Column:
    """The year in which the fiscal year (1 April to 31 March) of a day ends."""
    return F.year(F.add_months(day, -3)) + 1


def ist_from_utc(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), ts)


def local_name(x: Column) -> Column:
    return F.regexp_replace(x, r"^\{[^}]*\}", "")


def article_id(url: Column, headline: Column, published_at: Column) -> Column:
    """An article's name: of its address, or of headline and day where it has none."""
    basis = F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(normalise_text(headline), F.lit("|"), F.date_format(published_at, "yyyy-MM-dd")))
    return F.substring(F.sha1(basis), 1, 20)


def news_id(article: Column, isin: Column) -> Column:
    """The name of an article's row for one company; the article's own where it names none."""
    return F.when(isin.isNull(), article).otherwise(F.concat(article, F.lit(":"), isin.cast("string")))


def truncated(x: Column, n: int, mark: str = "") -> Column:
    """The first n characters of a text; a longer one ends in ``mark`` and is n long with it."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - len(mark)), F.lit(mark))).otherwise(x)


def ordinal(x: Column) -> Column:
    """1st, 2nd, 3rd, 11th of a number, rounded."""
    n = F.rint(x).cast("long")
    ending = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def duration(seconds: Column) -> Column:
    """5s, 2m 05s, 1h 02m; a dash for none."""
    whole = F.floor(seconds).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    minutes = F.floor(whole / 60).cast("long")
    short = F.concat(F.rint(seconds).cast("long").cast("string"), F.lit("s"))
    return F.when(seconds.isNull(), "\u2014").when(seconds < 60, short).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), two(whole % 60), F.lit("s"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), two(minutes % 60), F.lit("m")))


def crore_text(x: Column) -> Column:
    """An amount with thousands apart, two places below 100; nothing for none."""
    known = x.isNotNull() & ~F.isnan(x)
    return F.when(~known, "").when(F.abs(x) >= 100, F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def percent_text(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 2), F.lit("%"))

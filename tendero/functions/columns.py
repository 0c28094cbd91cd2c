"""Column builders: numeric types, growth and margin, text and date formats."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Measures of a line are whole numbers of minor units: exact, and some twenty times
# cheaper per row than a cast of the stored double to a decimal. The value is the
# number of decimal places.
PLACES = {"units": 2, "gross": 2, "cost": 2, "doc_total": 2, "net": 4, "discount": 4}

# A sum is kept as two sums, of the high and of the low 20 bits. Neither overflows
# at a trillion rows, which the plain sum of ten-thousandths would.
BITS = 20
LOW = (1 << BITS) - 1


def minor(c: Column | str, places: int = 2) -> Column:
    """A stored double as a whole number of minor units."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * 10**places).cast("long")


def exact(c: Column | str, places: int | None = None) -> Column:
    """Minor units as a decimal."""
    if isinstance(c, str):
        places = PLACES[c] if places is None else places
        c = F.col(c)
    return c.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-places))


def _joined(high: Column, low: Column, places: int) -> Column:
    whole = high.cast("decimal(19,0)") * F.lit(1 << BITS) + low.cast("decimal(19,0)")
    return (whole * F.lit(Decimal(1).scaleb(-places))).cast(T.DecimalType(32, places))


def _measure(c: Column | str, places: int | None, only: Column | None) -> tuple[Column, int]:
    if isinstance(c, str):
        places = PLACES[c] if places is None else places
        c = F.col(c)
    return (c if only is None else F.when(only, c).otherwise(F.lit(0))), places


def total(c: Column | str, places: int | None = None, only: Column | None = None) -> Column:
    """Exact decimal sum of minor units, of the rows where ``only`` holds."""
    x, places = _measure(c, places, only)
    return _joined(F.sum(F.shiftright(x, BITS)), F.sum(x.bitwiseAND(F.lit(LOW))), places)


def halves(*names: str) -> list[Column]:
    """Sums of measures left as two whole numbers each, to be summed further."""
    out = []
    for n in names:
        out.append(F.sum(F.shiftright(F.col(n), BITS)).alias(f"{n}_hi"))
        out.append(F.sum(F.col(n).bitwiseAND(F.lit(LOW))).alias(f"{n}_lo"))
    return out


def rolled_halves(*names: str) -> list[Column]:
    return [F.sum(f"{n}_{part}").alias(f"{n}_{part}") for n in names for part in ("hi", "lo")]


def rolled(name: str, only: Column | None = None) -> Column:
    """Exact decimal sum of a measure that ``halves`` has summed once."""
    high, low = F.col(f"{name}_hi"), F.col(f"{name}_lo")
    if only is not None:
        high, low = (F.when(only, x).otherwise(F.lit(0)) for x in (high, low))
    return _joined(F.sum(high), F.sum(low), PLACES[name])


def real(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in double, NULL where b is 0 or NULL.

    Not rounded: exact decimal sums give the same quotient on every run.
    """
    return F.try_divide(real(a), real(b))


def percent(a: Column | str, b: Column | str) -> Column:
    """100 a / b, NULL where b is 0 or NULL (PRJ-2, WIN-3)."""
    return ratio(a, b) * 100


def margin(price: Column | str, cost: Column | str) -> Column:
    """Margin of a price over its cost in percent (PRJ-2)."""
    return percent(real(price) - real(cost), cost)


def pending(total: Column | str, paid: Column | str) -> Column:
    """Balance still open; a missing payment counts as 0 (PRJ-3)."""
    paid = F.col(paid) if isinstance(paid, str) else paid
    total = F.col(total) if isinstance(total, str) else total
    return total - F.coalesce(paid, F.lit(0))


def tax_identity(subtotal: Column, tax: Column, total: Column, tolerance: float = 0.005) -> Column:
    """True where subtotal + tax gives the total (PRJ-4)."""
    return F.abs(real(subtotal) + real(tax) - real(total)) <= tolerance


def thousands(c: Column | str, decimals: int | None = None) -> Column:
    """``N/A`` for NULL, else a number with separators: no decimals for whole types, else two (FN-10)."""
    c = F.col(c) if isinstance(c, str) else c
    if decimals is None:
        whole = F.typeof(c).isin("tinyint", "smallint", "int", "bigint")
        shown = F.when(whole, F.format_number(c, 0)).otherwise(F.format_number(c, 2))
    else:
        shown = F.format_number(c, decimals)
    return F.when(c.isNull(), F.lit("N/A")).otherwise(shown)


def stamp(c: Column | str, with_time: bool = True) -> Column:
    """``N/A`` for NULL, else an ISO-like date or date and time (FN-13)."""
    c = F.col(c) if isinstance(c, str) else c
    shape = "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd"
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.date_format(c, shape))


def shorten(c: Column | str, limit: int = 100) -> Column:
    """Text cut to ``limit`` characters with an ellipsis; NULL gives '' (FN-14)."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    cut = F.concat(F.substring(c, 1, limit - 3), F.lit("..."))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def title_of(c: Column | str, limit: int = 50) -> Column:
    """First message as a title: cut at the last space before ``limit`` (FN-21)."""
    text = strip(F.col(c) if isinstance(c, str) else c)
    head = F.substring(text, 1, limit)
    cut = F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space, line ends included."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def date_like(c: Column | str) -> Column:
    """True where the text starts like a date (FN-16)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^\d{4}-\d{2}-\d{2}")


def volume_label(c: Column | str) -> Column:
    """Size of a table in words, by thresholds 100, 1k, 10k and 100k (FN-18)."""
    n = F.col(c) if isinstance(c, str) else c
    tail = F.concat(F.lit(" ("), F.when(n < 1000, n.cast("string"))
                    .otherwise(F.format_number(n, 0)), F.lit(" registros)"))
    word = (F.when(n < 100, F.lit("catálogo pequeño")).when(n < 1000, F.lit("catálogo mediano"))
            .when(n < 10000, F.lit("volumen moderado")).when(n < 100000, F.lit("volumen alto"))
            .otherwise(F.lit("volumen muy alto")))
    return F.concat(word, tail)


def log_volume(c: Column | str) -> Column:
    """Row count on a log scale, 1.0 from a million rows on (FN-20)."""
    n = F.col(c) if isinstance(c, str) else c
    return F.least(F.log10(n + 1) / 6, F.lit(1.0))


def plain_sql(c: Column | str) -> Column:
    """SQL text without comments and with single spaces (FN-22)."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"(?m)--.*$", "")
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for consumers without a decimal type."""
    return df.select([
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
        else F.col(f.name) for f in df.schema.fields
    ])

"""Filters of the sales model as Column builders."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of system articles, customers and codes, and code patterns.
SYSTEM_ARTICLES = (
    "VENTA GLOBAL", "VENTAS GLOBALES", "CORTE DE CAJA", "CORTE DIARIO", "APERTURA DE CAJA",
    "CIERRE DE CAJA", "AJUSTE DE INVENTARIO", "TRANSFERENCIA INTERNA",
    "%GLOBAL%", "%CORTE%", "%SISTEMA%", "%INTERNO%",
)
SYSTEM_ARTICLES_EXTRA = ("INTERNO", "AJUSTE")
SALE_EXCLUSIONS = ("VENTA GLOBAL", "CORTE", "SISTEMA")
SYSTEM_CUSTOMERS = ("CLIENTE MOSTRADOR", "PUBLICO GENERAL", "%INTERNO%")
SYSTEM_CODES = ("GLOBAL", "CORTE", "SISTEMA", "CTRL")
CODE_PATTERNS = (r"^[A-Z]{2,3}\d{3,6}$", r".*(CONTROL|SYS|INT)$", r"^(GLOBAL|CORTE|SISTEMA)")
NAME_COLUMNS = ("DESCRIPCION", "NOMBRE", "ARTICULO", "CLIENTE")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_period(c: Column, lo: str | Column | None, hi: str | Column | None) -> Column:
    """Half-open date range on the stored column, so the scan can prune (FLT-1)."""
    test = F.lit(True)
    if lo is not None:
        test = test & (c >= _moment(lo))
    if hi is not None:
        test = test & (c < _moment(hi))
    return test


def in_closed_period(c: Column, lo: str | Column, hi: str | Column) -> Column:
    """Closed range of days; the last one counts to its end (FLT-2)."""
    last = (F.lit(hi) if isinstance(hi, str) else hi).cast("date")
    return (c >= _moment(lo)) & (c < F.date_add(last, 1).cast("timestamp_ntz"))


def trailing(c: Column, as_of: str | Column, days: int) -> Column:
    """The last ``days`` days before ``as_of``, which may be a subquery (FLT-3, FLT-4)."""
    anchor = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return c >= F.date_sub(anchor, days).cast("timestamp_ntz")


def _moment(v: str | Column) -> Column:
    return (F.lit(v) if isinstance(v, str) else v).cast("timestamp_ntz")


def is_sale(c: Column | str = "doc_type", kind: str = "F") -> Column:
    """A document counts as a sale by its type alone (FLT-6)."""
    return (F.col(c) if isinstance(c, str) else c) == kind


def not_cancelled(c: Column, ok: str = "N") -> Column:
    """The older status rule, never on by default (FLT-7)."""
    return c == ok


def positive(*cols: str) -> Column:
    """All measures above zero; NULL does not pass (FLT-8)."""
    return reduce(lambda a, b: a & b, [F.col(c) > 0 for c in cols])


def is_system(name: Column, patterns: Sequence[str] = SALE_EXCLUSIONS) -> Column:
    """The name holds one of the patterns, case as written (FLT-11)."""
    return name.rlike("|".join(re.escape(p.strip("%")) for p in patterns))


def real_article(name: Column, patterns: Sequence[str] = SALE_EXCLUSIONS,
                 keep_unknown: bool = True) -> Column:
    """Not a system article. Unknown names stay (FLT-9) or drop (FLT-10)."""
    test = ~is_system(name, patterns)
    return name.isNull() | test if keep_unknown else test


def real_code(code: Column, codes: Sequence[str] = SYSTEM_CODES) -> Column:
    """Code is not on the list; NULL does not pass (FLT-12)."""
    return ~code.isin(list(codes))


def real_customer(name: Column, patterns: Sequence[str] = SYSTEM_CUSTOMERS) -> Column:
    """Neither the walk-in customer nor an internal one (FLT-13)."""
    exact = [p for p in patterns if not p.startswith("%")]
    return ~name.isin(exact) & ~is_system(name, [p for p in patterns if p.startswith("%")])


def odd_code(code: Column, patterns: Sequence[str] = CODE_PATTERNS) -> Column:
    """The code looks like an internal one (FLT-15)."""
    return any_of([code.rlike(p) for p in patterns])


def odd_length(text: Column, limit: int = 100) -> Column:
    """A description longer than articles have (FLT-16)."""
    return F.length(text) > limit


def edge_case(df: DataFrame, patterns: Sequence[str] | None = None,
              name_columns: Sequence[str] = NAME_COLUMNS) -> Column:
    """True for rows whose name-like text columns hold a system pattern (FLT-14).

    The columns come from the schema; the value is upper-cased, NULL is ''.
    """
    wanted = [p.strip("%").upper() for p in
              (patterns if patterns is not None else SYSTEM_ARTICLES + SYSTEM_ARTICLES_EXTRA)]
    named = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
             and any(k.upper() in f.name.upper() for k in name_columns)]
    pattern = "|".join(re.escape(p) for p in wanted)
    return any_of([F.upper(F.coalesce(F.col(n), F.lit(""))).rlike(pattern) for n in named])


def drop_edge_cases(df: DataFrame, patterns: Sequence[str] | None = None,
                    name_columns: Sequence[str] = NAME_COLUMNS) -> DataFrame:
    return df.where(~edge_case(df, patterns, name_columns))

"""Exact decimals out of table cells."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions.text import MISSING_FORMULA, strip

#: Fixed value: what counts as a number.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?$"
#: Fixed value: digits that any decimal(38, 10) holds as they are; all else is looked at closely.
DIGITS = r"^[0-9]{1,28}(?:\.[0-9]{1,10})?\z"
SCALE = 10
DECIMAL = f"decimal(38,{SCALE})"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def clean(cell: Column) -> Column:
    """In normal form C and trimmed. Only text of other than ASCII characters goes through Arrow."""
    other = cell.rlike("[^\\x00-\\x7F]")
    return strip(F.when(other, _nfc(F.when(other, cell))).otherwise(cell))


def decimal(cell: Column) -> Column:
    """The number, null where number_error() says why not."""
    t = strip(cell)
    return F.when(cell.rlike(DIGITS), cell.try_cast(DECIMAL)).when(_error(cell).isNull(), t.try_cast(DECIMAL))


def number_error(cell: Column) -> Column:
    """missing, blank, not a number, or out of range (of decimal(38, 10): nothing is rounded)."""
    return F.when(F.coalesce(~cell.rlike(DIGITS), F.lit(True)), _error(cell))


def _error(cell: Column) -> Column:
    t = strip(cell)
    plain = t.rlike(NUMBER)
    fraction = F.length(F.regexp_extract(t, r"\.([0-9]*?)0*(?:[eE]|$)", 1))
    power = F.coalesce(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    kept = t.try_cast(DECIMAL).isNotNull() & (fraction - power <= SCALE)
    return F.when(t == MISSING_FORMULA, "missing").when(t.isNull() | (t == ""), "blank").when(~plain | (F.length(t) > 128), "not a number").when(~kept, "out of range")


def render(number: Column) -> Column:
    """Plain notation without trailing zeros."""
    t = number.cast("string")
    return F.when(number == 0, "0").when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


@F.udf(StringType())
def mean40(total, n) -> str | None:
    """total / n to 40 significant digits, half to even: run on aggregated rows only."""
    if not n:
        return None
    with localcontext() as c:
        c.prec, c.rounding = 40, ROUND_HALF_EVEN
        x = Decimal(total) / Decimal(n)
    if not x:
        return "0"
    out = format(x, "f")
    return out.rstrip("0").rstrip(".") if "." in out else out

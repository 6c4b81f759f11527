"""Column functions. Missing values are NULL; nothing here produces NaN or infinity from finite input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing number.
MISSING = ("", "-", "NA", "N/A", "nan")


def parse_number(text: Column) -> Column:
    """Thousands commas and a byte-order mark are dropped; MISSING and anything that isn't a number give NULL."""
    bare = F.trim(F.regexp_replace(F.trim(text), "[,﻿]", ""))
    return F.when(~bare.isin(*MISSING), bare.try_cast("double"))


def parse_volume(text: Column) -> Column:
    """Digits with an optional K, M or B of either case."""
    pattern = r"^([0-9.]+)\s*([KMBkmb]?)$"
    bare = F.trim(text)
    unit = F.upper(F.regexp_extract(bare, pattern, 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.regexp_extract(bare, pattern, 1).try_cast("double") * factor


def year_in(text: Column) -> Column:
    """The first 20xx in a text."""
    return F.regexp_extract(text, r"20\d{2}", 0).try_cast("int")


def is_annual(label: Column) -> Column:
    return F.upper(F.trim(label)).startswith("ЗА")


def period_end(label: Column, year: Column) -> Column:
    """Last day of Q1..Q4, H1, H2; 31 December for annual labels; NULL otherwise."""
    code = F.upper(F.trim(label))
    march, june = F.make_date(year, F.lit(3), F.lit(31)), F.make_date(year, F.lit(6), F.lit(30))
    september, december = F.make_date(year, F.lit(9), F.lit(30)), F.make_date(year, F.lit(12), F.lit(31))
    return F.when(is_annual(label) | code.isin("Q4", "H2"), december).when(code.isin("Q2", "H1"), june).when(code == "Q1", march).when(code == "Q3", september)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within [low, high]; NULL stays NULL, and NULL bounds don't bind."""
    low, high = (b if isinstance(b, Column) else F.lit(float(b)) for b in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def bounded_label(z: Column, scale: float = 15.0) -> Column:
    return 50.0 * (1.0 + F.tanh(F.lit(scale / 50.0) * z))


def appetite(score: Column) -> Column:
    """The share of a score in [0, 100]."""
    return clip(score / 100.0, 0.0, 1.0)


def capacity(leverage: Column, cash: Column, kappa: float = 3.0, tau: float = 1.0) -> Column:
    """A logistic brake on leverage above tau; 0 without positive cash flow."""
    return F.when(cash > 0, 1.0 / (1.0 + F.exp(F.lit(kappa) * (leverage - tau)))).when(cash.isNotNull(), 0.0)


def bias_bound(alpha: float, spread: float) -> float:
    return spread * (alpha / 2) ** 2


def keyed_uniform(*key: Column | str) -> Column:
    """A uniform number in (0, 1) from the text of a key: the same on every engine, in any order of rows."""
    text = F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(k) for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def keyed_truncated_normal(alpha: float, key: list[Column | str], tries: int = 8) -> Column:
    """N(0, (alpha/2)^2), the first of `tries` Box-Muller draws within +-alpha, else 0."""
    draws = [
        F.sqrt(-2.0 * F.ln(keyed_uniform(*key, f"{t}a"))) * F.cos(2 * 3.141592653589793 * keyed_uniform(*key, f"{t}b")) * (alpha / 2)
        for t in range(tries)
    ]
    return F.coalesce(F.try_element_at(F.filter(F.array(*draws), lambda x: F.abs(x) <= alpha), F.lit(1)), F.lit(0.0))

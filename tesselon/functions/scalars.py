"""Column expressions with pinned null, NaN and tie semantics.

Missing measurements are null from ``clean`` on; every other function then has the
same meaning as skipping NaN, and no comparison ever meets a NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: C) -> Column:
    """NaN and infinities become null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def divide(a: C, b: C) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def divide_positive(a: C, b: C) -> Column:
    """a / b where b > 0, else null."""
    return F.when(col(b) > 0, F.try_divide(col(a).cast("double"), col(b).cast("double")))


def corr(x: C, y: C) -> Column:
    """Pearson r over rows where both are present; null for a constant side."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def log_ratio(out: C, into: C) -> Column:
    """ln((out + 1) / (into + 1))."""
    return F.log((col(out) + 1) / (col(into) + 1))


def clip(c: C, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def fisher_z(r: C, bound: float = 0.999999) -> Column:
    """atanh of r clipped to +-bound."""
    return F.atanh(clip(r, -bound, bound))


def is_close(a: C, b: C, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    a, b = col(a), b if isinstance(b, Column) else F.lit(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def share(cond: Column) -> Column:
    """The share of rows where cond holds; null counts as no."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def complete(*cols: C) -> Column:
    """All present."""
    out = F.lit(True)
    for c in cols:
        out = out & col(c).isNotNull()
    return out


def stars(p: C) -> Column:
    """Significance marks."""
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def p_text(p: C) -> Column:
    """A p value for a label: scientific under 0.001, else three decimals."""
    p = col(p)
    return F.when(p < 0.001, F.lit("p<0.001")).otherwise(F.concat(F.lit("p="), F.format_string("%.3f", p)))


def recode(c: C, names: dict, default=None) -> Column:
    """names[c]; default where absent (P13, P14). Pair with require_no_null for the
    strict form."""
    out = F.lit(None)
    for k, v in reversed(list(names.items())):
        out = F.when(col(c) == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def without_leading_zeros(c: C) -> Column:
    """'AB007' -> 'AB7' for capitals followed by a zero-padded number."""
    return F.regexp_replace(F.trim(col(c)), "^([A-Z]+)0+([0-9]+)$", "$1$2")


def side_suffix(c: C) -> tuple[Column, Column]:
    """(name without a trailing _L or _R, 'L', 'R' or '')."""
    c = col(c)
    has = c.rlike("_[LR]$")
    return F.when(has, F.substr(c, F.lit(1), F.length(c) - 2)).otherwise(c), F.when(has, F.right(c, F.lit(1))).otherwise("")


def side_prefix(c: C) -> Column:
    """Drops a leading l or r before a capital."""
    c = col(c)
    return F.when(c.rlike("^[lr][A-Z]"), F.substr(c, F.lit(2))).otherwise(c)


def last_int(c: C, sep: str) -> Column:
    """The integer after the last separator: 'subject_13' -> 13."""
    return F.element_at(F.split(col(c), sep), -1).cast("long")


def has_token(c: C, tokens: list[str], sep: str = ";") -> Column:
    """Whether a separated list holds any of the tokens."""
    return F.arrays_overlap(F.split(col(c), sep), F.array(*map(F.lit, tokens)))


def joined_sorted(c: C, sep: str = ";") -> Column:
    """Aggregate: the distinct values, sorted and joined."""
    return F.array_join(F.sort_array(F.collect_set(col(c))), sep)


def order_rank(c: C, order: list) -> Column:
    """Position in a custom order, after all for other values."""
    return recode(c, {v: i for i, v in enumerate(order)}, len(order))


def dummies(c: C, levels: list, prefix: str) -> list[Column]:
    """0/1 columns of each sorted level but the first."""
    return [F.when(col(c) == v, 1.0).otherwise(0.0).alias(f"{prefix}_{v}") for v in sorted(levels)[1:]]


def half_even(c: C, digits: int = 0) -> Column:
    """Rounding half to even."""
    return F.bround(col(c), digits)

"""Row-local column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: ColumnLike) -> Column:
    """NaN and both infinities become NULL."""
    c = as_column(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_ln(c: ColumnLike) -> Column:
    """Natural logarithm; NULL for anything not above zero, which is what ``ln`` does here."""
    return F.ln(as_column(c))


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient with NULL instead of an error or an infinity when the denominator is zero."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def round_even(c: ColumnLike) -> Column:
    """Round to an integer, halves to the even neighbour."""
    return F.bround(as_column(c), 0)


def sigmoid(z: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-as_column(z)))


def sigmoid_grad(o: ColumnLike) -> Column:
    """Slope of the sigmoid, written in terms of its output."""
    o = as_column(o)
    return o * (1.0 - o)


def binary_flag(c: ColumnLike, digits: int | None = None) -> Column:
    """1 above zero, 0 otherwise, NULL for NULL.

    ``digits`` rounds first, so that a difference of two means that is zero on paper does not turn
    into a flag through the last bit of a float.
    """
    c = as_column(c)
    if digits is not None:
        c = F.round(c, digits)
    return F.when(c > 0, 1).when(c <= 0, 0)


def predicted_class(p: ColumnLike) -> Column:
    p = as_column(p)
    return F.when(p < 0.5, 0).when(p >= 0.5, 1)


def hit_flag(p: ColumnLike, y: ColumnLike) -> Column:
    """1 when score and label lie on the same side of one half."""
    return ((as_column(p) >= 0.5) == (as_column(y) >= 0.5)).cast("int")


def residual(y: ColumnLike, p: ColumnLike, sign: str = "y-p") -> Column:
    if sign not in ("y-p", "p-y"):
        raise ValueError("sign is 'y-p' or 'p-y'")
    difference = as_column(y) - as_column(p)
    return difference if sign == "y-p" else -difference


def squared_error(d: ColumnLike) -> Column:
    """Half of the squared residual, the loss every fit here minimises."""
    d = as_column(d)
    return 0.5 * d * d


def scale_const(c: ColumnLike, factor: float) -> Column:
    return as_column(c) * F.lit(float(factor))


def cast_numeric(c: ColumnLike) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return as_column(c).try_cast("double")


def bin_index(p: ColumnLike, bins: int) -> Column:
    """1-based index of the right-closed bin of width ``1/bins`` that holds ``p`` of [0, 1]."""
    return F.greatest(F.lit(1), F.ceil(as_column(p) * bins)).cast("int")


def bin_label(index: ColumnLike, bins: int) -> Column:
    """``"0.05 to 0.10"`` for bin 2 of 20; decimals come from the integer, so the text is exact.

    There are two decimals, and more where neighbouring bins would otherwise share a label.
    """
    index = as_column(index)
    digits = max(2, len(str(bins - 1)))
    edge = lambda i: (i.cast("decimal(9,0)") / F.lit(bins).cast("decimal(9,0)")).cast(f"decimal({digits + 2},{digits})").cast("string")
    return F.concat_ws(" to ", edge(index - 1), edge(index))


def indexed_name(prefix: str, index: ColumnLike) -> Column:
    """``w0``, ``w1``, … for the rows and columns of a weight table."""
    return F.concat(F.lit(prefix), as_column(index).cast("string"))


def normal_density(x: ColumnLike, mean: ColumnLike, sd: ColumnLike) -> Column:
    z = ratio(as_column(x) - as_column(mean), sd)
    return ratio(F.exp(-0.5 * z * z), as_column(sd) * F.sqrt(F.lit(2.0) * F.pi()))

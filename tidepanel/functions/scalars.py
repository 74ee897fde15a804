"""Null-aware scalar expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: str | Column, low: float | Column | None, high: float | Column | None) -> Column:
    """Bound a value; greatest/least skip NULL, so a NULL input is kept explicitly."""
    value = col(value)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), bounded)


def ratio(top: str | Column, bottom: str | Column) -> Column:
    bottom = col(bottom)
    return col(top) / F.when(bottom != 0, bottom)


def sum_of(values: list[Column]) -> Column:
    return reduce(add, values)


def all_of(values: list[Column]) -> Column:
    return reduce(and_, values)


def complete(names: list[str]) -> Column:
    return all_of([F.col(name).isNotNull() for name in names])


def mean_of(values: list[Column]) -> Column:
    """Row mean that skips NULL and is NULL when nothing is present."""
    present = sum_of([F.when(v.isNotNull(), 1).otherwise(0) for v in values])
    total = sum_of([F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(present > 0, total / present)


def softmax(values: list[Column]) -> list[Column]:
    top = F.greatest(*values)
    parts = [F.exp(v - top) for v in values]
    total = sum_of(parts)
    return [p / total for p in parts]


def entropy_confidence(probabilities: list[Column]) -> Column:
    terms = [p * F.log(clip(p, 1e-12, None)) for p in probabilities]
    return 1.0 + sum_of(terms) / F.log(F.lit(float(len(probabilities))))


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a two-way split, zero at both ends."""
    q = 1.0 - p
    return F.when(
        p.isNotNull(),
        -(
            F.when(p > 0, p * F.log2(p)).otherwise(0.0)
            + F.when(q > 0, q * F.log2(q)).otherwise(0.0)
        ),
    )


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF in column arithmetic.

    |z| < 3: the alternating-free series phi(z) * sum z^(2k+1)/(2k+1)!!; beyond that the
    continued fraction of the upper tail.  Both are below 1e-12 absolute error.
    """
    z = F.abs(x)
    density = F.exp(-z * z / 2.0) * F.lit(0.3989422804014327)
    square = z * z
    series = F.lit(1.0)
    for k in range(40, 0, -1):
        series = 1.0 + series * square / float(2 * k + 1)
    near = density * z * series
    tail = z
    for k in range(40, 0, -1):
        tail = z + float(k) / tail
    far = 0.5 - density / tail
    half = F.when(z < 3.0, near).otherwise(far)
    return F.when(x.isNotNull(), 0.5 + F.signum(x) * half)


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles for comparison; adding zero turns a negative zero into zero."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, special.get(field.name, digits)) + F.lit(0.0)
        out.append(c.alias(field.name))
    return df.select(*out)

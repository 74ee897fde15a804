"""Window frames with a minimum number of observations.

Two frames cover the reference calendars:

* ``rows``: counts the key's own rows.
* ``steps``: counts positions of a shared calendar index (``cal``).  A key that did not print
  at a position simply has no row there, and a range frame over the index still spends that
  position.  No densified copy of the panel is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.scalars import col, ratio


def _names(key: str | tuple[str, ...] | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


class Frame:
    """One trailing window; every aggregate is NULL below ``least`` observations."""

    def __init__(self, window: WindowSpec, least: int) -> None:
        self.window = window
        self.least = least

    def at_least(self, least: int) -> Frame:
        return Frame(self.window, least)

    def _guard(self, observed: Column, value: Column) -> Column:
        return F.when(F.count(observed).over(self.window) >= self.least, value)

    def count(self, x: str | Column) -> Column:
        return F.count(col(x)).over(self.window)

    def agg(self, fn, x: str | Column) -> Column:
        x = col(x)
        return self._guard(x, fn(x).over(self.window))

    def sum(self, x) -> Column:
        return self.agg(F.sum, x)

    def mean(self, x) -> Column:
        return self.agg(F.avg, x)

    def std(self, x) -> Column:
        return self.agg(F.stddev_samp, x)

    def std0(self, x) -> Column:
        return self.agg(F.stddev_pop, x)

    def var(self, x) -> Column:
        return self.agg(F.var_samp, x)

    def min(self, x) -> Column:
        return self.agg(F.min, x)

    def max(self, x) -> Column:
        return self.agg(F.max, x)

    def product(self, x) -> Column:
        return self.agg(F.product, x)

    def quantile(self, x, q: float) -> Column:
        return self.agg(lambda c: F.percentile(c, F.lit(q)), x)

    def median(self, x) -> Column:
        return self.quantile(x, 0.5)

    def corr(self, x, y) -> Column:
        """Pairwise-complete correlation, NULL when either side is constant."""
        x, y = _pair(x, y)
        w = self.window
        flat = (F.min(x).over(w) == F.max(x).over(w)) | (F.min(y).over(w) == F.max(y).over(w))
        return self._guard(x, F.when(~flat, F.corr(x, y).over(w)))

    def cov(self, x, y) -> Column:
        x, y = _pair(x, y)
        return self._guard(x, F.covar_samp(x, y).over(self.window))

    def zscore(self, x) -> Column:
        x = col(x)
        return (x - self.mean(x)) / _nonzero(self.std(x))

    def share_at_most_last(self, x) -> Column:
        """Share of the window's values that do not exceed the current one."""
        x = col(x)
        held = F.collect_list(x).over(self.window)
        return self._guard(
            x, F.size(F.filter(held, lambda v: v <= x)).cast("double") / F.size(held)
        )


def _nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def _pair(x, y) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def ordered(key, order) -> WindowSpec:
    return Window.partitionBy(*_names(key)).orderBy(*_names(order))


def rows(key, order, n: int, least: int | None = None, end: int = 0) -> Frame:
    """Last ``n`` rows ending ``end`` rows from the current one (``end=-1`` excludes it)."""
    return Frame(ordered(key, order).rowsBetween(end - n + 1, end), n if least is None else least)


def before(key, order, least: int = 1) -> Frame:
    """All strictly earlier rows."""
    return Frame(ordered(key, order).rowsBetween(Window.unboundedPreceding, -1), least)


def upto(key, order, least: int = 1) -> Frame:
    """All rows up to and including the current one."""
    return Frame(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0), least)


def steps(key, cal: str, n: int, least: int | None = None, end: int = 0) -> Frame:
    """Last ``n`` positions of the calendar index column."""
    return Frame(
        Window.partitionBy(*_names(key)).orderBy(F.col(cal)).rangeBetween(end - n + 1, end),
        n if least is None else least,
    )


def steps_before(key, cal: str, least: int = 1) -> Frame:
    return Frame(
        Window.partitionBy(*_names(key))
        .orderBy(F.col(cal))
        .rangeBetween(Window.unboundedPreceding, -1),
        least,
    )


def step_lag(x, key, cal: str, k: int = 1) -> Column:
    """Value exactly ``k`` calendar positions earlier, NULL if the key did not print there."""
    w = Window.partitionBy(*_names(key)).orderBy(F.col(cal)).rangeBetween(-k, -k)
    return F.max(col(x)).over(w)


def within(*key: str) -> WindowSpec:
    return Window.partitionBy(*key)


def mean_rank(x: str | Column, *key: str, descending: bool = False) -> Column:
    """Average rank of the present values inside the key, ties averaged, NULL kept."""
    x = col(x)
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    lowest = F.rank().over(Window.partitionBy(*key).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*key, x))
    return F.when(x.isNotNull(), lowest + (ties - 1) / 2.0)


def pct_rank(x: str | Column, *key: str) -> Column:
    """Average rank divided by the number of present values."""
    x = col(x)
    return mean_rank(x, *key) / F.count(x).over(Window.partitionBy(*key))


def leave_one_out(x: str | Column, *key: str) -> Column:
    """Mean of the other members' present values, also for a member without a value."""
    x = col(x)
    w = Window.partitionBy(*key)
    total = F.coalesce(F.sum(x).over(w), F.lit(0.0)) - F.coalesce(x, F.lit(0.0))
    others = F.count(x).over(w) - F.when(x.isNotNull(), 1).otherwise(0)
    return ratio(total, others.cast("double"))

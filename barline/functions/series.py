"""Measures over bars as arrays inside tasks: each pass takes a symbol's bars together and gives them back with more columns.

Spark groups the bars by symbol; the arrays of each come apart into rows again, so that the
partitioning by symbol stays and what follows has no exchange. Sums run from the oldest bar to
the newest, as in a window's frame.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import PLACES

_EXACT = Context(prec=400, rounding=ROUND_HALF_UP)


def rounded(x: np.ndarray, places: int = PLACES) -> np.ndarray:
    """columns.measure of an array: half up by the decimal digits; what lies near a half is rounded as a decimal."""
    scale = 10.0**places
    with np.errstate(all="ignore"):
        y = x * scale
        out = np.rint(y) / scale
        near = np.abs(np.abs(y - np.floor(y)) - 0.5) <= 1e-6 + np.abs(y) * 4e-16
    for i in np.flatnonzero(near & np.isfinite(x)):
        out[i] = float(_EXACT.quantize(Decimal(repr(float(x[i]))), Decimal(1).scaleb(-places)))
    return out + 0.0


def over(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """a / b, missing where b is 0."""
    with np.errstate(all="ignore"):
        return np.where(np.equal(b, 0), np.nan, a / b)


class Series:
    """A symbol's bars, oldest first; a missing value is NaN. at: a bar's place."""

    def __init__(self, rows: pa.Table, order: str):
        key = rows.column(order)
        if pc.any(pc.less(key[1:], key[:-1])).as_py() or key.null_count:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(order, "ascending")], null_placement="at_start"))
        self.rows, self.known, self.at = rows, {}, np.arange(len(rows))

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = self.rows.column(name).cast(pa.float64()).to_numpy()
        return self.known[name]

    def lag(self, x: np.ndarray, k: int, missing: float = np.nan) -> np.ndarray:
        """x of k bars ago."""
        if k == 0:
            return x
        out = np.full(len(x), missing, x.dtype)
        out[k:] = x[:-k]
        return out

    def total(self, x: np.ndarray, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the values of n bars, the newest `skip` bars ago."""
        ok = ~np.isnan(x)
        value, total = np.where(ok, x, 0.0), np.zeros(len(x))
        count = np.clip(self.at + 1 - skip, 0, n).astype("float64") if ok.all() else sum(self.lag(ok.astype("float64"), k, 0.0) for k in range(skip, n + skip))
        for k in range(min(n + skip, len(x)) - 1, skip - 1, -1):
            total[k:] += value[: len(x) - k]
        return total, count

    def mean(self, x: np.ndarray, n: int, least: int = 1, skip: int = 0) -> np.ndarray:
        """Mean of n bars once `least` of them have a value."""
        total, count = self.total(x, n, skip)
        return np.where(count >= max(1, least), over(total, count), np.nan)

    def slope(self, y: np.ndarray, n: int) -> np.ndarray:
        """Least-squares slope of n bars, all with a value, in percent of their mean per bar."""
        first, joint = self.lag(y, n - 1), np.zeros(len(y))
        for k in range(n - 1, -1, -1):
            joint += ((n - 1) / 2 - k) * (self.lag(y, k) - first)
        return over(joint / (n * (n * n - 1) / 12), self.mean(y, n, n)) * 100.0

    def least(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """Row of the least x of the bars from last to first ago, the oldest of equals, a missing one before all; -1 if there is no bar."""
        key = np.where(np.isnan(x), -np.inf, x)
        best, row = np.full(len(x), np.inf), np.full(len(x), -1)
        here = np.arange(len(x))
        for k in range(min(last, len(x) - 1), first - 1, -1):
            other = key[: len(x) - k]
            better = other < best[k:]
            np.copyto(best[k:], other, where=better)
            np.copyto(row[k:], here[: len(x) - k], where=better)
        return row


def pick(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """x of these rows, missing for -1."""
    return np.where(row >= 0, x[row], np.nan)


def _column(x: np.ndarray, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.DoubleType):
        return pa.array(x, pa.float64(), from_pandas=True)
    missing = np.isnan(x)
    return pa.array(np.where(missing, 0, x).astype("bool" if isinstance(kind, T.BooleanType) else "int32"), mask=missing)


def by_symbol(df: DataFrame, added: dict[str, str], run: Callable[[Series], dict[str, np.ndarray]], order: str = "bar", newest: bool = False) -> DataFrame:
    """df with the columns `added` (name -> double, int or boolean) that run makes of each symbol's bars in that order; newest: its last bar only."""
    names = [c for c in df.columns if c != "symbol" and c not in added]
    kinds = {c: df.schema[c].dataType for c in names} | {k: {"double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}[t] for k, t in added.items()}
    kind = T.StructType([T.StructField(k, T.ArrayType(t)) for k, t in kinds.items()])

    def measured(*columns: pa.Array) -> pa.Scalar:
        s = Series(pa.table(list(columns), names), order)
        made = run(s)
        out = [*[s.rows.column(c).combine_chunks() for c in names], *[_column(made[k], kinds[k]) for k in added]]
        ends = pa.array([max(0, len(s) - 1) if newest else 0, len(s)], pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, c) for c in out], list(kinds))[0]

    # hints, as the kind of a function of arrays is known by them
    measured.__annotations__ = {"columns": pa.Array, "return": pa.Scalar}
    rows = df.groupBy("symbol").agg(F.arrow_udf(measured, kind)(*names).alias("_m"))
    # no aliases: the optimizer's constraints double with each one above a filter
    each = rows.select("symbol", F.inline(F.arrays_zip(*[f"_m.`{c}`" for c in kinds])))
    return each.select(*[c for c in df.columns if c not in added], *added)

"""Column helpers over the bars of a ticker in time order."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, TIME = "ticker", "time"
#: -log of the weight that a bar has a block of bars later, in an exponential mean: 1e-150.
DECAY = 345.0


def bars_window():
    return Window.partitionBy(KEY).orderBy(TIME)


def last_bars(n: int):
    return bars_window().rowsBetween(-(n - 1), 0)


def rolling(agg, x: Column, n: int, least: int | None = None) -> Column:
    """``agg(x)`` over the last ``n`` bars, null while fewer than ``least`` (``n``) of them have a value."""
    over = last_bars(n)
    return F.when(F.count(x).over(over) >= (n if least is None else least), agg(x).over(over))


def stretch(sums: str, part: int, n: int) -> Column:
    """The sum over the last ``n`` bars, from the column ``sums`` of those over the last ``part``, which ``n`` is a multiple of."""
    return reduce(add, [F.coalesce(F.lag(sums, k).over(bars_window()), F.lit(0)) if k else F.col(sums) for k in range(0, n, part)])


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(bars_window())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(x, n).over(bars_window())


def ewm(df: DataFrame, x: str, alpha: float, out: str, warmup: int = 0) -> DataFrame:
    """Add y(t) = (1 - alpha) y(t-1) + alpha x(t), started at the first value; null for the first ``warmup`` values.

    Within a block of bars the recursion is a running sum of x (1 - alpha)^-t; a block starts from the end of the
    one before it. Blocks are so long that (1 - alpha)^length is 1e-150: in a double's range, and far below its precision, so
    older blocks no longer count. A null is left out and has no mean itself: the others' are as if its bar weren't there.
    """
    q, whole = 1 - alpha, bars_window().rowsBetween(Window.unboundedPreceding, 0)
    size = max(1, int(DECAY / -math.log(q))) if q > 0 else 1
    df = df.withColumn("_i", F.count(x).over(whole) - 1).withColumn("_b", F.floor(F.col("_i") / size)).withColumn("_j", F.col("_i") - F.col("_b") * size)
    term = F.col(x) * F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(q), -F.col("_j"))
    block = Window.partitionBy(KEY, "_b").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_local", F.pow(F.lit(q), F.col("_j")) * F.sum(term).over(block))
    ended = F.when(F.col("_j") == size - 1, F.col("_local"))
    before = F.coalesce(F.max(ended).over(Window.partitionBy(KEY).orderBy("_b").rangeBetween(-1, -1)), F.lit(0.0))
    value = F.col("_local") + F.pow(F.lit(q), F.col("_j") + 1) * before
    return df.withColumn(out, F.when(F.col(x).isNotNull() & (F.col("_i") >= warmup), value)).drop("_i", "_b", "_j", "_local")

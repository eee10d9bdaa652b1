"""Descriptions of returns that can be merged: counts, moments and a quantile sketch for each group.

A row of sketches is small, so a group's rows can be kept by day or by load and merged later, without the trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values up to which a sketch holds all of them; beyond, ranks are off by ERROR of all values at most, 99 times of 100, the grid's step included.
K = 4096
GRID = 2 * K
ERROR = 1.2 / K**0.9 + 1 / GRID
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
PART = ["n", "total", "spread", "least", "most", "sketch"]


def sketches(rows: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    """``by`` and, of each group, ``n, total, spread, least, most, sketch``: spread is the sum of squared gaps from the mean. Nulls and NaN don't count."""
    x = F.col(value).cast("double")
    sound = rows.filter(x.isNotNull() & ~F.isnan(x)).withColumn("_x", x)
    return sound.groupBy(*by).agg(
        F.count("_x").alias("n"), F.sum("_x").alias("total"), (F.var_pop("_x") * F.count("_x")).alias("spread"),
        F.min("_x").alias("least"), F.max("_x").alias("most"), F.kll_sketch_agg_double("_x", F.lit(K)).alias("sketch"),
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Rows of sketches of the same group as one; in any order and grouping the same counts and moments."""
    mean = F.sum("total") / F.sum("n")
    between = F.sum(F.col("total") * F.col("total") / F.col("n")) - F.sum("total") * mean
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("spread") + F.greatest(F.lit(0.0), between)).alias("spread"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"),
    )


def quantile(share: float) -> Column:
    """The value at a share of the way through the group, between two neighbours in proportion, as data frames describe it.

    ``_grid`` are the sketch's values at ``GRID`` even ranks: enough that each value of a group of ``K`` is among them.
    """
    at = (F.col("n") - 1) * F.lit(share)
    low = F.floor(at)

    def nth(n: Column) -> Column:  # by the rank in the middle of its step
        return F.element_at("_grid", F.greatest(F.lit(1), F.round((F.least(n, F.col("n") - 1) + F.lit(0.5)) / F.col("n") * GRID).cast("int")))

    return nth(low) + (at - low) * (nth(low + 1) - nth(low))


def described(parts: DataFrame) -> DataFrame:
    """``count, mean, std, min, q25, median, q75, max`` of rows of sketches; one value has no deviation.

    Quartiles are exact for groups of at most ``K`` values, and else of a rank that is off by ``ERROR`` at most, 99 times of 100.
    """
    keys = [c for c in parts.columns if c not in PART]
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("spread") / (F.col("n") - 1)))
    ranks = F.split(F.lit(",".join(str(i / GRID) for i in range(1, GRID + 1))), ",").cast("array<double>")
    parts = parts.withColumn("_grid", F.kll_sketch_get_quantile_double("sketch", ranks))
    return parts.select(*keys, F.col("n").alias("count"), (F.col("total") / F.col("n")).alias("mean"), deviation.alias("std"), F.col("least").alias("min"), *[quantile(q).alias(name) for name, q in QUARTILES.items()], F.col("most").alias("max"))


def describe(rows: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    return described(sketches(rows, by, value))


def dropped(rows: DataFrame, signal: str, hold: int) -> DataFrame:
    """Why signals make no trade: ``reason, n`` of those without a next bar, without a bar to sell on, or with a price that isn't above 0; ``kept`` for the rest."""
    from barloom.functions.rolling import lead

    entry, exit_, here = lead("open", 1), lead("open", hold + 1), F.lit(True)
    rows = rows.withColumns({"_entry": entry, "_exit": exit_, "_next": lead(here, 1), "_last": lead(here, hold + 1)})
    reason = F.when(F.col("_next").isNull(), "no_entry_bar").when(F.col("_last").isNull(), "no_exit_bar").when(~F.coalesce((F.col("_entry") > 0) & (F.col("_exit") > 0), F.lit(False)), "bad_price").otherwise("kept")
    return rows.filter(F.col(signal)).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))

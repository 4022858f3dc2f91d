"""Running values over rows in order, without all rows of a group in one task.

Rows are dealt to ranges of a number that they are ordered by, whose bounds are quantiles of the whole table. A value runs
within each range, and starts from what the ranges before it, one row each, amount to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def range_of(df: DataFrame, order: str, n: int | None = None) -> Column:
    """The number of the range that a row falls into: 0 for every row where ``order`` is no number."""
    if not isinstance(df.schema[order].dataType, T.NumericType):
        return F.lit(0)
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)] or [0.5], 20 * n).alias("at")).first()["at"]
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds or []))]).cast("array<double>"), lambda b: b < F.col(order)))


def running(df: DataFrame, by: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """df with columns of running values, each (sum or max, expression), within ``by`` in order, the row itself included."""
    combine = {"sum": lambda a, b: a + b, "max": F.greatest}
    made = df.withColumn("_range", range_of(df, order[0])).withColumns({f"_{k}": e for k, (_, e) in values.items()})
    parts = made.groupBy(*by, "_range").agg(*[getattr(F, kind)(f"_{k}").alias(f"_part_{k}") for k, (kind, _) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select(*by, "_range", *[getattr(F, kind)(f"_part_{k}").over(earlier).alias(f"_start_{k}") for k, (kind, _) in values.items()])
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = made.withColumns({f"_{k}": getattr(F, kind)(f"_{k}").over(own) for k, (kind, _) in values.items()})
    on = [local[c].eqNullSafe(start[c]) for c in [*by, "_range"]]
    joined = local.join(start.hint("merge"), on).drop(*[start[c] for c in [*by, "_range"]])
    return joined.withColumns({k: F.when(F.col(f"_start_{k}").isNull(), F.col(f"_{k}")).otherwise(combine[kind](F.col(f"_{k}"), F.col(f"_start_{k}"))) for k, (kind, _) in values.items()}).drop("_range", *[f"_{k}" for k in values], *[f"_start_{k}" for k in values])

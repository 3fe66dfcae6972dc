"""The N highest rows of every group, by lower bounds taken from partitions.

Any N rows of a group give a bound: the group's N-th best row is at least as
good as the worst of them. Each partition finds its local N-th best per group
in one pass, the highest of these bounds per group is joined back, and only
rows at or above it are ranked. What is ranked is at most N rows a group and
partition, however large a group is. Bounds are broadcast for groups with more
than 1/HOT_SHARE of the rows, so at most HOT_SHARE of them; smaller groups
need none, since none of them can crowd a task, and are ranked as they are.

Defined results: rows without a group are left out (or kept as a group of
their own with keep_null_group); a null or NaN order value ranks after all
others; a group of fewer than N rows is returned whole; rows equal in all
order columns are interchangeable, so the last order column should be unique;
an empty table gives an empty table. Further columns pass through unchanged;
one named as the rank is replaced by it. Decimals of over 18 digits are
compared as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscale.runtime import HOT_SHARE, cut_lineage

_PREFIX = "__top_"
#: Rows kept beside the best ones before they are sorted again; it grows with the best, so each row is sorted a few times at most.
BUFFER = 100_000


def _keys(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Numeric columns of which each is better if larger, nulls last."""
    keys = []
    for name, descending in order:
        kind = df.schema[name].dataType
        value = F.col(f"`{name}`")
        if isinstance(kind, T.BooleanType):
            value = value.cast("int")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.unix_micros(value.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            value = F.unix_date(value)
        elif not isinstance(kind, T.NumericType):
            raise ValueError(f"order column {name} is a {kind.simpleString()}; numbers, times and booleans can be ordered")
        if isinstance(kind, T.DecimalType) and kind.precision <= 18:
            value, kind = (value * 10**kind.scale).cast("long"), T.LongType()
        # ~x reverses the order of whole numbers without overflow at the smallest one
        whole = not isinstance(kind, (T.FractionalType, T.DecimalType))
        value = value.cast("long") if whole else F.nullif(value.cast("double"), F.lit(float("nan")))
        turned = value if descending else (F.bitwise_not(value) if whole else -value)
        keys += [value.isNotNull().cast("int"), F.coalesce(turned, F.lit(0).cast("long" if whole else "double"))]
    return keys


def top_n(df: DataFrame, group: str, order: list[tuple[str, bool]], n: int, rank: str = "rank_no", keep_null_group: bool = False) -> DataFrame:
    """The first n rows of each group in the given order [(column, descending), ...], with their rank from 1."""
    names = [f"{_PREFIX}{i}" for i in range(2 * len(order))]
    keyed = df.withColumns(dict(zip(names, _keys(df, order))))
    if not keep_null_group:
        keyed = keyed.where(F.col(f"`{group}`").isNotNull())
    own, rows, bound = f"{_PREFIX}group", f"{_PREFIX}rows", f"{_PREFIX}bound"
    kept = keyed.select(F.col(f"`{group}`").alias(own), *names)

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        """The n best rows of each group, with the number of rows they stand for in the first of them."""
        whole = pd.concat(parts, ignore_index=True)
        order = np.lexsort([whole[name].to_numpy() for name in reversed(names)])[::-1]
        place = whole[own].iloc[order]
        code = pd.factorize(place, use_na_sentinel=False)[0]
        nth = pd.Series(code).groupby(code).cumcount().to_numpy()
        total = np.bincount(code, weights=whole[rows].to_numpy()[order]) if len(code) else np.array([])
        out = whole.iloc[order[nth < n]].copy()
        kept_code, kept_nth = code[nth < n], nth[nth < n]
        out[rows] = np.where(kept_nth == 0, total[kept_code], 0).astype("int64")
        out["_nth"] = kept_nth
        return out

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, least = 0, BUFFER
        for batch in batches:
            held.append(batch.assign(**{rows: 1}))
            size += len(batch)
            if size >= least:
                held = [best(held).drop(columns="_nth")]
                size = len(held[0])
                least = 2 * size + BUFFER
        if size:
            out = best(held)
            # a group's rows are counted in its first row, its bound is its n-th
            for at in range(0, len(out), BUFFER):
                part = out.iloc[at : at + BUFFER]
                part = part[(part["_nth"] == 0) | (part["_nth"] == n - 1)]
                yield part.assign(**{bound: part["_nth"] == n - 1}).drop(columns="_nth")

    schema = T.StructType([*kept.schema.fields, T.StructField(rows, T.LongType()), T.StructField(bound, T.BooleanType())])
    found = kept.mapInPandas(local, schema).groupBy(own).agg(F.sum(rows).alias(rows), F.max(F.when(F.col(bound), F.struct(*names))).alias(bound))
    found = cut_lineage(found.where(f"{rows} >= {int(n)}"))
    total = found.agg(F.sum(rows)).first()[0] or 0
    same = F.col(f"`{group}`").eqNullSafe(F.col(own))
    enough = F.col(bound).isNull() | (F.struct(*names) >= F.col(bound))
    bounds = F.broadcast(found.where(F.col(rows) > total / HOT_SHARE).drop(rows))
    survivors = keyed.join(bounds, same, "left").where(enough).drop(own, bound)
    window = Window.partitionBy(F.col(f"`{group}`")).orderBy(*[F.col(name).desc() for name in names])
    return survivors.withColumn(rank, F.row_number().over(window).cast("long")).where(F.col(rank) <= n).drop(*names)

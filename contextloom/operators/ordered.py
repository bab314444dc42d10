"""Running sums and streaming folds over ordered rows of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contextloom.storage import materialize


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row of its group, in order; nulls count 0.

    Rows are range-partitioned by group and order, so a group of any size is spread over many tasks; each
    part is summed on its own, and the parts' totals, one row each, give the offsets.
    """
    ordered = materialize(
        df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("__part", F.spark_partition_id()), "ordered"
    )
    amount = F.coalesce(F.col(value), F.lit(0))
    keys = [*group, "__part"]
    totals = ordered.groupBy(*keys).agg(F.sum(amount).alias("__total"))
    before = totals.select(*keys, (F.sum("__total").over(W.partitionBy(*group).orderBy("__part")) - F.col("__total")).alias("__before"))
    inside = ordered.withColumn("__inside", F.sum(amount).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = inside.alias("a").join(before.alias("b"), same, "inner")
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("b.__before") + F.col("a.__inside")).cast("long").alias(name))


def ordered_fold(df: DataFrame, group: str, order: Sequence[str], start: Callable[[], object], fold: Callable[[object, pd.DataFrame], tuple], schema: str, columns: Sequence[str], result: str) -> DataFrame:
    """A fold that can't be a running sum: each group's rows pass one task in order, as a sorted stream.

    ``fold(state, rows)`` gets consecutive rows of one group and returns the new state and an array, the ``result`` of
    each row; it is called once per batch and group, so it can work on whole columns. The sort spills and the
    fold keeps one state, so a task's memory doesn't grow with its group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            keys = pdf[group].to_numpy()
            out = []
            begin = 0
            while begin < len(keys):
                here = keys[begin]
                differs = np.flatnonzero(keys[begin:] != here)
                end = begin + int(differs[0]) if len(differs) and differs[0] > 0 else len(keys) if not len(differs) else begin + 1
                if here != current:
                    current, state = here, start()
                part = pdf.iloc[begin:end]
                state, values = fold(state, part)
                out.append(part.assign(**{result: values}))
                begin = end
            yield pd.concat(out) if out else pdf.assign(**{result: []})

    return df.select(*columns).repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)

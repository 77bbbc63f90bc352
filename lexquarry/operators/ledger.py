"""Ledgers: admission under a ceiling, running totals, rollups, errors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Money is exact: it is counted in ten-thousandths.
MONEY = "decimal(18,4)"


def _units(cost: Column) -> Column:
    return (cost.cast(MONEY) * 10_000).cast("long")


def admissions(calls: DataFrame, ceiling: float | str) -> DataFrame:
    """Whether each call of a run is admitted: it is iff what was admitted before plus its cost stays within
    ``ceiling``; a refused call uses nothing, so a later cheaper one may pass.

    Decisions feed back, so a run is worked off in order (ts, ord) in one pass that holds one number: rows
    come sorted and in batches, and a run may be of any length. Needs run_id, ts, ord and cost; a null cost is 0.
    """
    most = int(Decimal(str(ceiling)) * 10_000)
    kind = calls.schema["run_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = object(), 0
        for batch in batches:
            admitted = []
            for run_id, cost in zip(batch["run_id"].tolist(), batch["units"].tolist()):
                if run_id != current:
                    current, used = run_id, 0
                ok = used + cost <= most
                used += cost if ok else 0
                admitted.append(ok)
            batch["admitted"] = admitted
            yield batch[["run_id", "ord", "units", "admitted"]]

    units = F.coalesce(_units(F.col("cost")), F.lit(0)).alias("units")
    ordered = calls.select("run_id", "ts", "ord", units).repartition("run_id").sortWithinPartitions("run_id", "ts", "ord")
    judged = ordered.mapInPandas(run, f"run_id {kind}, ord long, units long, admitted boolean")
    return judged.select("run_id", "ord", (F.col("units") / F.lit(10_000).cast("decimal(5,0)")).cast(MONEY).alias("cost"), "admitted")


def running_totals(log: DataFrame) -> DataFrame:
    """Spent so far and rank of each entry of its run, by (ts, ord)."""
    w = Window.partitionBy("run_id").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("spent", F.sum("cost").over(w)).withColumn("n", F.count(F.lit(1)).over(w))


def rollup(log: DataFrame, *keys: str) -> DataFrame:
    return log.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


def error_rows(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """(rows with ``id``, node, kind) of several steps as one table of errors."""
    out = None
    for df, node, kind in parts:
        one = df.select(F.lit(node).alias("node"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out

"""Running values along an order within keys, where one key may hold any share of the rows.

A window partitioned by the key sorts a hot key in one task.  Here the rows are range-partitioned
by (key, order) together, so a hot key lies over as many partitions as its size asks for.  Within
a partition a window runs over that partition's part of the key; what a part hands on to the next
ones of its key - its sum, its last known value - is one row per key and partition, and only keys
that lie over several partitions need any: two a partition at most, so the table that is broadcast
holds no more rows than twice the partitions.

Rows of equal key and order stay together and run in an arbitrary order, as in any window.  Null
keys are a key, null orders come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.columns import c
from kestrel.storage import materialize

#: Before the first and after the last row of a partition's part of a key.
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


class Runs:
    """``df`` placed by (key, order): the window of a part, and what reaches a part from the others of its key."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.columns, self.keys = df.columns, list(keys)
        self.names = [f"__r{k}" for k in range(len(self.keys))]
        self.order = [F.col(f"__o{k}") for k in range(len(order))]
        given = df.withColumns({n: c(k) for n, k in zip(self.names, keys, strict=True)} | {f"__o{k}": c(o) for k, o in enumerate(order)})
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.by = [*(F.col(n) for n in self.names), *self.order]
        self.rows, _ = materialize(given.repartitionByRange(parts, *self.by).withColumn("__p", F.spark_partition_id()), "runs")
        self.part = Window.partitionBy("__p", *self.names).orderBy(*self.order)

    def carried(self, parts: dict[str, Column], before: dict[str, Column], after: dict[str, Column] | None = None) -> DataFrame:
        """__p, the key and what comes from the parts before and after it, for the keys that lie over several partitions.

        ``parts`` aggregates a part; ``before`` and ``after`` aggregate these over the other parts of the key.
        """
        edges = self.rows.groupBy("__p", *self.names).agg(*(v.alias(k) for k, v in parts.items()))
        edges, _ = materialize(edges, "edges")
        # A key's parts: no more than there are partitions.
        along = Window.partitionBy(*self.names).orderBy("__p")
        whole = Window.partitionBy(*self.names)
        told = {k: v.over(along.rowsBetween(FIRST, -1)) for k, v in before.items()} | {k: v.over(along.rowsBetween(1, LAST)) for k, v in (after or {}).items()}
        spread = edges.withColumns(told | {"__parts": F.count(F.lit(1)).over(whole)}).where("__parts > 1")
        return spread.select(F.col("__p").alias("__q"), *(F.col(n).alias(f"{n}_") for n in self.names), *told)

    def joined(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        same = [F.col("__p") == F.col("__q"), *(F.col(n).eqNullSafe(F.col(f"{n}_")) for n in self.names)]
        return rows.join(F.broadcast(carried), same, "left")  # two rows a partition at most


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str | Column]) -> DataFrame:
    """``df`` with a column for each of ``values``: the sum of its expression over the rows before, 0 for the first."""
    own = {f"__v{k}": (c(v) if isinstance(v, str) else v) for k, v in enumerate(values.values())}
    runs = Runs(df.withColumns(own), keys, order)
    rows = runs.rows.withColumns({f"__s{k}": F.coalesce(F.sum(v).over(runs.part.rowsBetween(FIRST, -1)), F.lit(0)) for k, v in enumerate(own)})
    carried = runs.carried({f"__t{k}": F.sum(v) for k, v in enumerate(own)}, {f"__b{k}": F.sum(f"__t{k}") for k in range(len(own))})
    total = {out: F.col(f"__s{k}") + F.coalesce(F.col(f"__b{k}"), F.lit(0)) for k, out in enumerate(values)}
    return runs.joined(rows, carried).select(*(c(n) for n in df.columns), *(v.alias(out) for out, v in total.items()))


def filled(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], both_ways: bool = True) -> DataFrame:
    """Nulls of ``columns`` take the last known value before them in their key, else (``both_ways``) the first after."""
    runs = Runs(df, keys, order)
    known = lambda f, value: f(value, ignorenulls=True)
    back = runs.part.rowsBetween(FIRST, Window.currentRow)
    on = runs.part.rowsBetween(Window.currentRow, LAST)
    rows = runs.rows.withColumns({f"__f{k}": known(F.last, c(n)).over(back) for k, n in enumerate(columns)})
    if both_ways:
        rows = rows.withColumns({f"__n{k}": known(F.first, c(n)).over(on) for k, n in enumerate(columns)})
    place = F.struct(*runs.order, F.lit(0)) if runs.order else F.lit(0)
    held = lambda f, n: f(F.when(c(n).isNotNull(), c(n)), F.when(c(n).isNotNull(), place))
    parts = {f"__l{k}": held(F.max_by, n) for k, n in enumerate(columns)} | {f"__e{k}": held(F.min_by, n) for k, n in enumerate(columns)}
    before = {f"__b{k}": known(F.last, F.col(f"__l{k}")) for k in range(len(columns))}
    after = {f"__a{k}": known(F.first, F.col(f"__e{k}")) for k in range(len(columns))} if both_ways else {}
    done = runs.joined(rows, runs.carried(parts, before, after))
    values = {
        n: F.coalesce(f"__f{k}", f"__b{k}", *((f"__n{k}", f"__a{k}") if both_ways else ())) for k, n in enumerate(columns)
    }
    return done.select(*(values[n].alias(n) if n in values else c(n) for n in df.columns))


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with, under each name of ``columns``, the value of the column in the row before it of its key; null for the first."""
    runs = Runs(df, keys, order)
    rows = runs.rows.withColumns({f"__g{k}": F.lag(c(n)).over(runs.part) for k, n in enumerate(columns.values())} | {"__i": F.row_number().over(runs.part)})
    value = F.struct(*(c(n).alias(f"v{k}") for k, n in enumerate(columns.values())))
    carried = runs.carried({"__l": F.max_by(value, F.struct(*runs.order))}, {"__b": F.last("__l")})
    done = runs.joined(rows, carried)
    first = F.col("__i") == 1
    return done.select(*(c(n) for n in df.columns), *(F.when(first, F.col("__b").getField(f"v{k}")).otherwise(F.col(f"__g{k}")).alias(out) for k, out in enumerate(columns)))

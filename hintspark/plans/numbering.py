"""Places and running sums over a whole table's order, without gathering it in one task.

Rows are dealt into sorted ranges and stored; a range's totals, a row for each range, are added up on the
driver and given to the ranges behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hintspark.plans.shared import SharedTables

SHIFT = 33


class Ordered:
    """A stored table in sorted ranges. order should tell rows apart; else rows that are equal in it stand in any order."""

    def __init__(self, rows: DataFrame, order: list[Column | str], tables: SharedTables | None = None):
        tables = tables or SharedTables(rows.sparkSession, "ordered")
        self.columns = rows.columns
        self.rows = tables.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))

    def _with_totals(self, rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """rows with __range, and as __before_<name> the sums over all ranges before."""
        ranged = rows.withColumn("__range", F.shiftright("__place", SHIFT))
        found = ranged.groupBy("__range").agg(*(F.sum(c).alias(n) for n, c in sums.items())).orderBy("__range").collect()
        before, offsets = dict.fromkeys(sums, 0), []
        for r in found:
            offsets.append((r["__range"], *before.values()))
            before = {n: before[n] + (r[n] or 0) for n in sums}
        kinds = {n: dict(ranged.select(c.alias(n)).dtypes)[n] for n, c in sums.items()}
        wide = {n: "double" if k in ("double", "float") else "long" for n, k in kinds.items()}
        schema = ", ".join(["__range long", *(f"`__before_{n}` {k}" for n, k in wide.items())])
        offsets = [(at, *(float(v) if wide[n] == "double" else int(v) for n, v in zip(sums, values))) for at, *values in offsets]
        return ranged.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, schema)), "__range")

    def numbered(self, name: str = "place") -> DataFrame:
        """All rows with their place, counted from 1."""
        inside = F.col("__place").bitwiseAND(F.lit((1 << SHIFT) - 1))
        return self._with_totals(self.rows, {name: F.lit(1)}).select(*self.columns, (F.col(f"__before_{name}") + inside + 1).alias(name))

    def running(self, sums: dict[str, Column], only: DataFrame | None = None) -> DataFrame:
        """Rows with sums over themselves and all rows before; only: some of self.rows, perhaps with more columns."""
        rows = self.rows if only is None else only
        upto = W.partitionBy("__range").orderBy("__place")
        out = self._with_totals(rows, sums)
        added = {n: F.col(f"__before_{n}") + F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
        return out.withColumns(added).drop("__range", *(f"__before_{n}" for n in sums))


def numbered_within(rows: DataFrame, by: list[str], order: list[Column | str], name: str, tables: SharedTables | None = None) -> DataFrame:
    """rows with their place inside their group, counted from 1; a large group is spread over ranges."""
    placed = Ordered(rows, [*by, *order], tables).numbered(name)
    first = placed.groupBy(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by))).agg(F.min(name).alias("__first"))
    own = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)))
    return placed.join(first, own).select(*rows.columns, (F.col(name) - F.col("__first") + 1).alias(name))

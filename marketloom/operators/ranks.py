"""Ranks and nearest neighbours in order, without one task for all rows of a group.

Rows are dealt by range of (group, order) and sorted inside each range; a row's rank is its place in its range after the
counts of the ranges before. What is dealt by range is written down first: another run could draw other ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(df: DataFrame) -> DataFrame:
    """df, computed once: a checkpoint in the shared folder that spark.checkpoint.dir names, else kept by the executors."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """rows with their rank from 1 inside each group of `by`, in ascending `order` (nulls first), which should tell all rows of a group apart."""
    placed = settled(_dealt(rows, [*by, *order]).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{i}") for i, c in enumerate(by)]
    names = [f"__{i}" for i in range(len(by))]
    counts = placed.groupBy(*keyed, part.alias("__part")).agg(F.min("__place").alias("__least"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    shifts = counts.select(*names, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__shift"))
    on = [*names, "__part"]
    return placed.select("*", *keyed, part.alias("__part")).join(shifts, on).withColumn(name, F.col("__place") + F.col("__shift") + 1).select(*rows.columns, name)


def _runs(table: pa.Table | pa.RecordBatch, by: str) -> list[tuple[str, int, int]]:
    groups = np.array(table.column(by).to_pylist(), object)
    edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
    return [(groups[a], a, b) for a, b in zip(edges, edges[1:]) if b > a]


def neighbour_reach(points: DataFrame, by: str = "cell", value: str = "value", k: int = 3) -> DataFrame:
    """points(by, value, ...) with low and high: the stretch around a point that ends at its k-th nearest other point of the group (the farthest if there are fewer); NULL for a lone point.

    Points lie sorted in ranges. The k points at both ends of each range's part of a group, its halo, are all that
    other ranges need; as a part may have fewer, the halos of k parts before and after are put together.
    """
    columns = points.columns
    placed = settled(_dealt(points, [by, value]).withColumn("__part", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[str, list] = {}
        tails: dict[str, list] = {}
        part = 0
        for batch in batches:
            part = batch.column("__part")[0].as_py() if batch.num_rows else part
            values = batch.column(value).to_numpy()
            for group, a, b in _runs(batch, by):
                heads[group] = [*heads.get(group, []), *values[a : a + k].tolist()][:k] if len(heads.get(group, [])) < k else heads[group]
                tails[group] = [*tails.get(group, []), *values[max(a, b - k) : b].tolist()][-k:]
        columns = list(heads), [part] * len(heads), list(heads.values()), [tails[g] for g in heads]
        kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["g", "part", "head", "tail"])

    halo = placed.select(by, value, "__part").mapInArrow(ends, "g string, part int, head array<double>, tail array<double>")
    order = Window.partitionBy("g").orderBy("part")  # a row for each range of a group
    before, after = F.flatten(F.collect_list("tail").over(order.rowsBetween(-k, -1))), F.flatten(F.collect_list("head").over(order.rowsBetween(1, k)))
    halo = halo.select(F.col("g").alias("__g"), F.col("part").alias("__of"), F.slice(before, F.greatest(F.size(before) - k + 1, F.lit(1)), k).alias("__before"), F.slice(after, 1, k).alias("__after"))
    joined = placed.join(halo, (F.col(by) == F.col("__g")) & (F.col("__part") == F.col("__of")))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in points.schema.fields)}, low double, high double"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(value)
        own, left, right = table.column(value).to_numpy(), table.column("__before")[0].as_py(), table.column("__after")[0].as_py()
        every = np.concatenate([left, own, right])
        at = len(left) + np.arange(len(own))
        other = np.full((len(own), 2 * k), np.nan)
        for j in range(1, k + 1):
            for column, step in ((j - 1, -j), (k + j - 1, j)):
                inside = (at + step >= 0) & (at + step < len(every))
                other[inside, column] = every[at[inside] + step]
        gaps = np.where(np.isnan(other), np.inf, np.abs(other - own[:, None]))
        nearest, known = np.argsort(gaps, axis=1, kind="stable"), np.isfinite(gaps).sum(axis=1)
        pick = nearest[np.arange(len(own)), np.minimum(k, np.maximum(known, 1)) - 1]
        edge, radius = other[np.arange(len(own)), pick], gaps[np.arange(len(own)), pick]
        # the side of the neighbour ends exactly at it
        low, high = np.where(edge <= own, edge, own - radius), np.where(edge >= own, edge, own + radius)
        lone = known == 0
        return table.select(columns).append_column("low", pa.array(low, pa.float64(), mask=lone)).append_column("high", pa.array(high, pa.float64(), mask=lone))

    return joined.groupBy("__g", "__of").applyInArrow(one, schema)


def counts_below(data: DataFrame, queries: DataFrame, by: str = "cell", value: str = "value", name: str = "below") -> DataFrame:
    """queries(by, value, strict, ...) with the number of data rows of the group under their value, or at it too where strict is false: one sort of both, running counts, and the counts of the ranges before."""
    columns = queries.columns
    marked = data.select(by, value, F.lit(1).alias("__side")).unionByName(queries.withColumn("__side", F.when(F.col("strict"), 0).otherwise(2)), allowMissingColumns=True)
    placed = _dealt(marked, [by, value, "__side"]).withColumn("__part", F.spark_partition_id())
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in marked.schema.fields)}, __part int, __in long"

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n = None, 0
        for batch in batches:
            seen = np.zeros(batch.num_rows, np.int64)
            is_data = batch.column("__side").to_numpy() == 1
            for g, a, b in _runs(batch, by):
                if g != group:
                    group, n = g, 0
                seen[a:b] = n + np.cumsum(is_data[a:b])
                n = int(seen[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen)], names=[*batch.schema.names, "__in"])

    counted = settled(placed.mapInArrow(running, schema))
    ends = counted.groupBy(F.col(by).alias("__g"), F.col("__part").alias("__hp")).agg(F.max("__in").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__hp").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ends.select("__g", "__hp", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    found = counted.filter("__side <> 1").join(shifts, (F.col(by) == F.col("__g")) & (F.col("__part") == F.col("__hp")))
    return found.withColumn(name, F.col("__in") + F.col("__shift")).select(*columns, name)


#: The series is taken so far out.
_SHIFT = 6


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on: the asymptotic series from n + 6, less the terms between."""
    x = n.cast("double")
    z = x + _SHIFT
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - 1 / (132 * z**10) + 691 / (32760 * z**12)
    for i in range(_SHIFT):
        series = series - 1 / (x + i)
    return series


def mutual_information(long: DataFrame, k: int = 3) -> DataFrame:
    """(feature, mi) of long(feature, label, value): mutual information of a continuous feature with a class label, from nearest neighbours (Ross 2014).

    A point's radius reaches its k-th nearest neighbour of its own class; m counts all points nearer than that
    (itself, and at a radius of 0 its equals, included). A class of one point is left out; NULL and NaN values too.
    """
    rows = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("label").isNotNull()).select("feature", F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value"))
    cells = rows.withColumn("cell", F.concat_ws("\u0001", "feature", "label"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_class"))  # a row for each feature and class
    near = neighbour_reach(cells, "cell", "value", k).filter("low IS NOT NULL").join(sizes, "cell")
    points = settled(near.select("feature", "value", "low", "high", "n_class", F.monotonically_increasing_id().alias("id")))
    equal = F.col("low") == F.col("high")
    upper = points.select("feature", "id", F.col("high").alias("value"), (~equal).alias("strict"))
    lower = points.select("feature", "id", F.col("low").alias("value"), equal.alias("strict"))
    data = points.select("feature", "value")
    inside = counts_below(data, upper, "feature", "value", "hi").select("feature", "id", "hi").join(counts_below(data, lower, "feature", "value", "lo").select("feature", "id", "lo"), ["feature", "id"])
    terms = points.join(inside, ["feature", "id"]).withColumn("m", F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    out = terms.groupBy("feature").agg(
        (digamma(F.count(F.lit(1))) + F.avg(digamma(F.least(F.lit(k), F.col("n_class") - 1))) - F.avg(digamma(F.col("n_class"))) - F.avg(digamma(F.col("m")))).alias("mi")
    )
    return out.select("feature", F.greatest(F.col("mi"), F.lit(0.0)).alias("mi"))

"""Work along an order: folds over sorted streams of rows, and windows over a global order without a single task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weftline.session import cut

#: Rows that a fold gives out at a time.
ROWS = 10_000


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], schema: str) -> DataFrame:
    """What a fold makes of each group's rows in order, one row after the other.

    ``start`` makes the state of a group. Its ``take(*row)`` gets the columns behind the keys and yields what is ready,
    its ``end()`` yields the rest; both give tuples of the columns of ``schema`` behind the keys. Groups are dealt
    by their keys and sorted on disk if need be; a task passes over them once and holds one state, so a
    group may be of any length.
    """
    n = len(keys)
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{own}, {schema}"
    empty = rows.sparkSession.createDataFrame([], full).schema
    arrow = [_arrow(f.dataType) for f in empty.fields]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def ready() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*out), arrow)], names=[*keys, *names])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[:n] != at:
                    if state is not None:
                        out.extend((*at, *x) for x in state.end())
                    at, state = row[:n], start()
                out.extend((*at, *x) for x in state.take(*row[n:]))
                if len(out) >= ROWS:
                    yield ready()
        if state is not None:
            out.extend((*at, *x) for x in state.end())
        if out:
            yield ready()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(of_partition, full)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def in_order(rows: DataFrame, order: list[str], columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, groups: list[str] = [], number: str = "number", parts: int | None = None) -> DataFrame:  # noqa: B006
    """Rows with their place in the order of the whole table (``number``, from 0) and window columns over it.

    ``columns`` gets a window in that order (within ``groups``, by which the order must begin) and must look at most
    ``before`` and ``after`` rows away. ``order`` has to be total. Rows are dealt by ranges of the order and written;
    counts of the ranges give where each begins, and the rows near its ends are copied to the ranges that look
    at them. No task has more than its range and these copies.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a range
    bounds, total = [], 0
    for part in sorted(counts):
        bounds.append((part, total, total + counts[part]))
        total += counts[part]
    # one row a range
    ranges = F.broadcast(spark.createDataFrame(bounds, "__part int, __first long, __end long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = dealt.withColumn("__at", place).join(ranges, "__part").withColumn(number, F.col("__first") + F.col("__at"))
    own = numbered.select(*rows.columns, number, "__part", F.lit(True).alias("__own"))
    if before or after:
        numbered = cut(numbered)
        own = numbered.select(*rows.columns, number, "__part", F.lit(True).alias("__own"))
        edge = numbered.filter((F.col(number) - F.col("__first") < after) | (F.col("__end") - F.col(number) <= before)).select(*rows.columns, number, F.col("__part").alias("__from"))
        near = (F.col(number) >= F.col("__first") - before) & (F.col(number) < F.col("__end") + after) & (F.col("__from") != F.col("__part"))
        copies = edge.join(ranges, near).select(*rows.columns, number, "__part", F.lit(False).alias("__own"))
        own = own.unionByName(copies)
    window = Window.partitionBy("__part", *groups).orderBy(number)
    return own.withColumns(columns(window)).filter("__own").drop("__part", "__own")

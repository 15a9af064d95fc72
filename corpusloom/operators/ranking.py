"""Exact dense numbers by a global order, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stash, unused

#: monotonically_increasing_id has the row's place in its partition in its low bits.
PLACE_BITS = 33


def ranked(df: DataFrame, by: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name`` (long): ``start``, ``start`` + 1, ... in the order of ``by``.

    Rows are dealt into ranges of the order, sorted there and written once with their range and their place in it, so
    the numbers are the same in every later plan, however Spark joins or splits partitions. The ranges' sizes, one
    number each, come to the driver, and their running sum is added. Rows that tie in ``by`` are numbered in any order,
    but once; ``by`` should end in something unique. Nulls go where ``by`` says (first, unless told otherwise). A column
    called ``name`` is replaced; an empty table stays empty. As rows are written, give it narrow tables.
    """
    spark = df.sparkSession
    df = df.drop(name)
    part, place = unused("part", [*df.columns, name]), unused("place", [*df.columns, name])
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id()
    rows = rows.withColumn(part, F.shiftright(row, PLACE_BITS)).withColumn(place, row.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    written = stash(rows, "ranked")
    sizes = sorted(tuple(r) for r in written.groupBy(part).agg(F.max(place) + 1).collect())  # one row a partition
    before, offsets = start, []
    for number, size in sizes:
        offsets.append((number, before))
        before += size
    shift = spark.createDataFrame(offsets, f"{part} long, shift long").withColumnRenamed("shift", name)
    return written.join(F.broadcast(shift), part).withColumn(name, F.col(name) + F.col(place)).drop(part, place)

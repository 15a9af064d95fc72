"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources up to which the rate table is broadcast; a longer table is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Mean of one inverted Poisson; a larger rate is a sum of several, so that exp(-mean) never underflows.
LARGEST_MEAN = 32.0
#: Terms of the cumulative distribution: at a mean of 32 the rest is below 2**-53.
TERMS = 140
#: Copies of a row that one task makes at once; a rate above half of it sends rows through an exchange in spans of copies.
SPAN = 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(mean: Column) -> Column:
    """The array P(X <= 0), P(X <= 1), ... of a Poisson distribution."""
    first = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * mean / k).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )


def rates(docs: DataFrame, weights: DataFrame | None, target_rows: int | None) -> tuple[DataFrame, int, float]:
    """For each source its mean repetition rate: its share of the target rows over the rows it has; their number and the
    largest rate."""
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        shared = have.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        shared = have.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        shared = shared.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = shared.agg(F.sum("weight"), F.sum("rows"), F.count(F.lit(1)), F.max(F.col("weight") / F.col("rows"))).first()  # four numbers to the driver
    all_weight, all_rows, sources = float(sums[0] or 0), float(sums[1] or 0), sums[2]
    target = float(target_rows) if target_rows is not None else all_rows
    share = F.col("weight") / F.lit(all_weight) if all_weight > 0 else F.lit(0.0)
    largest = float(sums[3] or 0) / all_weight * target if all_weight > 0 else 0.0
    return shared.select("source", (share * F.lit(target) / F.col("rows")).alias("rate")), sources, largest


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, target_rows: int | None = None, seed: int = 17
) -> DataFrame:
    """Repeat each row of ``docs`` a Poisson number of times so that sources meet their target weights, then shuffle.

    ``weights`` has (source, weight); without it all sources weigh the same. A source's mean repetition rate is its
    share of ``target_rows`` (default: the rows of the input) over its own rows. The Poisson distribution is inverted
    at a number in [0, 1) hashed from the seed and the row's id, so the same row always gets the same count, on any
    cluster. Rows are then dealt out by a hash of seed, id and copy and sorted by it inside each partition: the order
    of the result is a global random permutation. Added columns: copy (from 1), n_copies, shuffle_key.

    Defined cases: a null source is a source of its own; a null doc_id is replaced by the text's MD5 as the hash seed;
    null and empty texts are rows like others; rows repeating a doc_id get the same count; a source that ``weights``
    lacks, or with a weight that is null, zero or negative, is left out; columns named copy, n_copies, shuffle_key or
    starting with ``__mix_`` in the input are replaced or dropped, all others are carried; an empty table gives an
    empty result.
    """
    docs = docs.drop("copy", "n_copies", "shuffle_key", *[c for c in docs.columns if c.startswith("__mix_")])
    table, sources, largest = rates(docs, weights, target_rows)
    table = table.select(
        F.col("source").alias("__mix_source"),
        F.ceil(F.col("rate") / LARGEST_MEAN).cast("int").alias("__mix_parts"),
        F.col("rate").alias("__mix_rate"),
    )
    table = table.where("__mix_parts > 0").withColumn(
        "__mix_cdf", poisson_cdf(F.col("__mix_rate") / F.col("__mix_parts"))
    )
    if sources <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    numbers = F.transform(
        F.sequence(F.lit(1), F.col("__mix_parts")), lambda j: uniform(F.lit(str(seed)), key, j.cast("string"))
    )
    count = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("__mix_cdf", lambda c: c <= u)))
    counted = docs.join(table, F.col("source").eqNullSafe(F.col("__mix_source"))).withColumn("n_copies", count)
    copies = counted.where("n_copies > 0").drop("__mix_source", "__mix_parts", "__mix_rate", "__mix_cdf")
    if largest > SPAN / 2:  # rows in spans of copies first, dealt out, so that no task makes all copies of a row
        copies = copies.withColumn("__mix_span", F.explode(F.expr(f"sequence(0, (n_copies - 1) div {SPAN})")))
        copies = copies.repartition(F.md5(F.concat_ws(":", key, F.col("__mix_span").cast("string"))))
        copies = copies.withColumn("copy", F.explode(F.expr(f"sequence(cast(__mix_span * {SPAN} + 1 AS int), cast(least(__mix_span * {SPAN} + {SPAN}, n_copies) AS int))"))).drop("__mix_span")
    else:
        copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), key, F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", order).repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs)


SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / n::DOUBLE AS rate FROM n),
p AS (SELECT source, greatest(ceil(rate / 32.0), 1)::INT AS parts, rate / greatest(ceil(rate / 32.0), 1) AS mean FROM r),
t AS (SELECT source, parts, k, exp(-mean) * CASE WHEN k = 0 THEN 1 ELSE mean ** k / factorial(k::INT) END AS p FROM p, range(0, 34) g(k)),
c AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
l AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source, parts),
u AS (
  SELECT d.doc_id, d.source, d.text, l.cdf,
         list_transform(range(1, l.parts + 1), lambda j: ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, md5(d.text), '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS us
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
m AS (SELECT doc_id, source, text, list_sum(list_transform(us, lambda x: len(list_filter(cdf, lambda v: v <= x))))::INT AS n_copies FROM u),
x AS (SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1))::INT AS copy FROM m WHERE n_copies > 0)
SELECT doc_id, source, text, n_copies, copy, md5('17:order:' || coalesce(doc_id::VARCHAR, md5(text), '') || ':' || copy) AS shuffle_key FROM x
"""

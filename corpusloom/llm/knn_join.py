"""Exact top-k search by inner product: a Voronoi kNN join with per-group bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import prepare

#: Pivots: the square root of the rows, at most so many and so many bytes; sampled rows for each, and rounds of k-means.
PIVOTS, PIVOT_BYTES, SAMPLE_EACH, ROUNDS = 1024, 16 << 20, 4, 6
#: Queries of a team at most, and the smaller sizes that are weighed against it.
TEAM_SIZES = (16_384, 4096, 1024, 256, 64)
#: Rows of one data chunk that meets a team in a task (chunks of small tables are smaller), and bytes of either's vectors.
CHUNK_LEAST, CHUNK_MOST, CHUNKS, SIDE_BYTES = 4096, 16_384, 16, 48 << 20
#: What moving a row to a team costs, in products of that row with a query.
MOVE_COST = 128
#: Cells of one score matrix that a task holds.
MATRIX = 2_000_000
SCALE = 64
LONG = np.iinfo(np.int64)


def quantised(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and floor(64 * x) of their components, as doubles (these are exact)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values) + 0.0  # no negative zeros
    good = np.isfinite(scaled).all(1)
    return rows[good], scaled[good]


def packed(v: np.ndarray) -> pa.Array:
    """Each vector as bytes: 16-bit integers where these hold it, else doubles."""
    short = (np.abs(v) < 2**15).all(1)
    return pa.array([(r.astype(np.int16) if s else r).tobytes() for r, s in zip(v, short)], pa.binary())


def unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    raw = [x.as_buffer() for x in column]
    short = np.array([len(x) == 2 * dim for x in raw], bool)
    out = np.empty((len(raw), dim))
    for kind, rows in ((np.int16, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        if len(rows):
            out[rows] = np.frombuffer(b"".join(raw[r].to_pybytes() for r in rows), kind).reshape(-1, dim)
    return out


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each vector: products with all pivots, its cell (ties: the first pivot), distance to that pivot, norm."""
    products, squares = v @ pivots.T, (v**2).sum(1)
    cell = (squares[:, None] - 2 * products + (pivots**2).sum(1)).argmin(1)
    return products, cell, np.sqrt(((v - pivots[cell]) ** 2).sum(1)), np.sqrt(squares)


def _assign(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Queries with their cell, distance to its pivot and norm."""
    for batch in batches:
        rows, v = quantised(batch["embedding"], pivots.shape[1])
        _, cell, away, norm = nearest(v, pivots)
        yield pa.record_batch(
            {"vec_id": batch["vec_id"].take(pa.array(rows)), "v": packed(v), "cell": pa.array(cell.astype(np.int32)), "away": pa.array(away), "norm": pa.array(norm)}
        )


@dataclass
class Groups:
    """The queries by cell: pivot, queries, largest distance to the pivot and largest norm of each; in the order of a
    chain from each pivot to the nearest one left, so that neighbours in the order are alike."""

    cells: np.ndarray
    pivots: np.ndarray
    queries: np.ndarray
    radius: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, rows: list, pivots: np.ndarray) -> Groups:
        rows = sorted(rows, key=lambda r: r["cell"])
        own = pivots[[r["cell"] for r in rows]]
        with np.errstate(all="ignore"):
            away = (own**2).sum(1)[:, None] - 2 * own @ own.T + (own**2).sum(1)
        order, left = [0], set(range(1, len(rows)))
        while left:
            order.append(min(left, key=lambda j: (away[order[-1], j], j)))
            left.remove(order[-1])
        rows = [rows[j] for j in order]
        column = lambda name, kind=float: np.array([r[name] for r in rows], kind)
        return cls(column("cell", np.int64), own[order], column("rows", np.int64), column("radius"), column("norm"))


def _summaries(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, groups: Groups, k: int) -> Iterator[pa.RecordBatch]:
    """Of this partition's vectors, for each group the k + 1 with the best scores that all its queries are sure of, and
    (as group -1) the largest norm."""
    low, ids, largest = np.full((0, len(groups.cells)), -np.inf), np.zeros((0, len(groups.cells)), np.int64), 0.0
    for batch in batches:
        rows, v = quantised(batch["embedding"], pivots.shape[1])
        own, first = np.unique(batch["vec_id"].take(pa.array(rows)).to_numpy(), return_index=True)
        if not len(own):
            continue
        norm = np.sqrt((v**2).sum(1))
        largest = max(largest, float(norm.max()))
        sure = v[first] @ groups.pivots.T - groups.radius * norm[first, None]
        low, ids = np.concatenate([low, sure]), np.concatenate([ids, np.broadcast_to(own[:, None], sure.shape)])
        if len(low) > k + 1:
            best = np.argpartition(-low, k, axis=0)[: k + 1]
            low, ids = np.take_along_axis(low, best, 0), np.take_along_axis(ids, best, 0)
    g = np.broadcast_to(np.arange(len(groups.cells), dtype=np.int32), low.shape)
    yield pa.record_batch(
        {
            "g": pa.array(np.append(g.ravel(), np.int32(-1)).astype(np.int32)),
            "vec_id": pa.array(np.append(ids.ravel(), 0)),
            "low": pa.array(np.append(low.ravel(), largest)),
        }
    )


@dataclass
class Bounds:
    """What a vector's score with some query of a group must reach to count, and the largest norm of all vectors."""

    groups: Groups
    floor: np.ndarray
    largest: float

    def needed(self, v: np.ndarray) -> np.ndarray:
        """[vector, group]: may the vector be among the k best of any of the group's queries?

        For a query q in the group of pivot p, at most r away from it: q.x <= p.x + r * |x|. As a distance, with a
        further component that gives all vectors the largest norm M: 2 * q.x = |q|^2 + M^2 - |q - x|^2, and
        |q - x| >= |p - x| - r. The smaller of both bounds the score from above. What can't be told is needed.
        """
        groups, squares = self.groups, (self.groups.pivots**2).sum(1)
        with np.errstate(all="ignore"):
            products = v @ groups.pivots.T
            direct = products + groups.radius * np.sqrt((v**2).sum(1))[:, None]
            away = np.sqrt(np.maximum(squares + self.largest**2 - 2 * products, 0.0))
            distant = (groups.norm**2 + self.largest**2 - np.maximum(away - groups.radius, 0.0) ** 2) / 2
            margin = 1e-9 * (1.0 + np.abs(self.floor) + (groups.norm + groups.radius + self.largest) ** 2)
            return ~(np.minimum(direct, distant) < self.floor - margin)


def teams_of(queries: np.ndarray, size: int) -> np.ndarray:
    """First groups of the teams: neighbouring groups share a team of up to ``size`` queries."""
    starts, room = [], 0
    for g, n in enumerate(queries.tolist()):
        if not starts or n > room:
            starts.append(g)
            room = max(size, n)
        room -= n
    return np.array(starts, np.int64)


def _counts(batches: Iterator[pa.RecordBatch], bounds: Bounds, levels: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each way of making teams, the rows of this partition that each team needs; as level -1 all rows."""
    found, rows = [np.zeros(len(starts), np.int64) for starts in levels], 0
    for batch in batches:
        _, v = quantised(batch["embedding"], bounds.groups.pivots.shape[1])
        needed, rows = bounds.needed(v), rows + len(v)
        for total, starts in zip(found, levels):
            total += np.logical_or.reduceat(needed, starts, axis=1).sum(0)
    level = np.repeat(np.arange(-1, len(levels)), [1, *map(len, found)])
    team = np.concatenate([[0], *(np.arange(len(x)) for x in found)])
    yield pa.record_batch({"level": pa.array(level.astype(np.int32)), "team": pa.array(team.astype(np.int32)), "n": pa.array(np.concatenate([[rows], *found]))})


def _needed_by(batches: Iterator[pa.RecordBatch], bounds: Bounds, starts: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Vectors with the teams that need them. Of a row that a batch repeats, no query can take more than k."""
    for batch in batches:
        rows, v = quantised(batch["embedding"], bounds.groups.pivots.shape[1])
        ids, raw = batch["vec_id"].take(pa.array(rows)), packed(v)
        if len(np.unique(ids.to_numpy())) < len(ids):
            seen: dict[tuple, int] = {}
            keep = []
            for r, key in enumerate(zip(ids.to_pylist(), raw.to_pylist())):
                seen[key] = seen.get(key, 0) + 1
                if seen[key] <= k:
                    keep.append(r)
            ids, raw, v = ids.take(pa.array(keep)), raw.take(pa.array(keep)), v[keep]
        needed = np.logical_or.reduceat(bounds.needed(v), starts, axis=1)
        row, team = np.nonzero(needed)
        offsets = np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(team.astype(np.int32)))
        yield pa.record_batch({"vec_id": ids, "v": raw, "teams": lists})


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; what no long can hold is at its ends."""
    dim, most = q.shape[1], [float(np.abs(y).max(initial=0)) for y in (q, x)]
    bound = most[0] * most[1] * dim
    if bound < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    limit = math.sqrt(2**53 / dim) * (1 - 1e-9)
    out = np.empty((len(q), len(x)), np.int64)
    plain_q, plain_x = (np.abs(y).max(1) < limit for y in (q, x))
    out[np.ix_(plain_q, plain_x)] = (q[plain_q] @ x[plain_x].T).astype(np.int64)
    whole = lambda y: [[int(c) for c in r] for r in y]
    exact = lambda a, b: min(max(sum(c * d for c, d in zip(a, b)), LONG.min), LONG.max)
    for qs, xs in ((np.arange(len(q)), np.flatnonzero(~plain_x)), (np.flatnonzero(~plain_q), np.flatnonzero(plain_x))):
        right = whole(x[xs])
        for r, a in zip(qs, whole(q[qs])):
            out[r, xs] = [exact(a, b) for b in right]
    return out


def _solve(queries: pa.Table, data: pa.Table, k: int, dim: int) -> pa.Table:
    """The k best of this tile's vectors for each of its queries."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    if queries.num_rows and data.num_rows:
        ids = data["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x, q, own = unpacked(data["v"], dim)[order], unpacked(queries["v"], dim), queries["vec_id"].to_numpy()
        n = len(x)
        for a in range(0, len(q), step := max(1, MATRIX // n)):
            scores = products(q[a : a + step], x)
            mine = ids[None, :] == own[a : a + step, None]
            if n > k and int(np.abs(scores).max(initial=0)) < LONG.max // (2 * n) and not (scores == LONG.min).any():
                joined = scores * n + np.arange(n - 1, -1, -1)  # ties go to the smaller id
                joined[mine] = LONG.min
                best = np.argpartition(joined, n - k, axis=1)[:, n - k :]
            else:
                best = np.stack([np.lexsort((np.arange(n), -s.astype(object) if (s == LONG.min).any() else -s, m))[:k] for s, m in zip(scores, mine)])
            row = np.repeat(np.arange(len(best)), best.shape[1])
            at = best.ravel()
            keep = ~mine[row, at]
            row, at = row[keep], at[keep]
            out.append((own[a : a + step][row], ids[at], scores[row, at]))
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))


@dataclass
class Plan:
    """How the join is cut: teams by their first groups, parts of each team's queries, chunks of the rows it needs; and
    the share of all rows that a team needs, on average."""

    pivots: np.ndarray
    bounds: Bounds
    starts: np.ndarray
    parts: list[int]
    chunks: list[int]
    share: float


def pivots_of(vectors: DataFrame, dim: int, rows: int) -> np.ndarray:
    """Pivots by some rounds of k-means on a bounded sample, which is taken by the hash of the vector itself; copies of
    one vector are all in it or none is, so four samples to one is enough room for the others unless these are chosen."""
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * dim), math.ceil(math.sqrt(rows))))
    chance = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    share = min(1.0, 2.0 * SAMPLE_EACH * most / rows)
    taken = vectors.where(F.size("embedding") == dim).where(chance < int(share * (1 << 30)) + 1)
    sample = taken.select("embedding").distinct().limit(SAMPLE_EACH * most).collect()
    _, found = quantised(pa.array([r["embedding"] for r in sample], pa.list_(pa.float64())), dim)
    points = np.unique(found, axis=0) if len(found) else np.zeros((1, dim))  # any pivots give right results
    pivots = points[np.random.default_rng(5).permutation(len(points))[:most]]
    for _ in range(ROUNDS if len(points) > most else 0):
        with np.errstate(all="ignore"):
            cell = nearest(points, pivots)[1]
            sums = np.zeros_like(pivots)
            np.add.at(sums, cell, points)
            count = np.bincount(cell, minlength=len(pivots))[:, None]
            pivots = np.where((count > 0) & np.isfinite(sums), sums / np.maximum(count, 1), pivots)
    return pivots


def plan(vectors: DataFrame, asked: DataFrame, pivots: np.ndarray, k: int) -> Plan | None:
    """Three passes over summaries only: the groups of queries, the scores they are sure of, the rows they need."""
    count = F.count(F.lit(1)).alias("rows")
    cells = asked.groupBy("cell").agg(count, F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()  # a row a pivot
    if not cells:
        return None
    groups = Groups.of(cells, pivots)
    sure = vectors.mapInArrow(partial(_summaries, pivots=pivots, groups=groups, k=k), "g int, vec_id long, low double")
    sure = sure.groupBy("g", "vec_id").agg(F.max("low").alias("low"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("low")))
    best = sure.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("g").agg(count, F.min("low").alias("low")).collect()
    floor, largest = np.full(len(groups.cells), -np.inf), 0.0
    for r in best:  # with k + 1 vectors of different ids, k at least are not the query's own
        if r["g"] < 0:
            largest = r["low"]
        elif r["rows"] == k + 1:
            floor[r["g"]] = r["low"]
    bounds = Bounds(groups, floor, largest)
    room = SIDE_BYTES // (8 * pivots.shape[1])
    sizes = sorted({max(1, min(s, room)) for s in TEAM_SIZES}, reverse=True)
    levels = [teams_of(groups.queries, s) for s in sizes]
    counted = vectors.mapInArrow(partial(_counts, bounds=bounds, levels=levels), "level int, team int, n long")
    have = {(r["level"], r["team"]): r["n"] for r in counted.groupBy("level", "team").agg(F.sum("n").alias("n")).collect()}
    total = have.get((-1, 0), 0)
    if not total:
        return None
    found = []
    for level, (size, starts) in enumerate(zip(sizes, levels)):
        members = np.add.reduceat(groups.queries, starts)
        needs = np.array([have[level, t] for t in range(len(starts))])
        parts = -(-members // size)
        found.append((float((needs * (parts * MOVE_COST + members)).sum()), level, starts, parts, needs))
    _, _, starts, parts, needs = min(found, key=lambda x: x[:2])
    chunk = max(1, min(CHUNK_MOST, room, max(CHUNK_LEAST, math.ceil(total / CHUNKS))))
    return Plan(pivots, bounds, starts, parts.tolist(), [max(1, math.ceil(n / chunk)) for n in needs.tolist()], float(needs.mean()) / total)


def usable(df: DataFrame) -> DataFrame:
    return df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def prepared(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, Plan] | None:
    """Usable vectors, quantised queries by cell and the plan of their join; None where either side is empty."""
    prepare(vectors.sparkSession)
    vectors, queries = usable(vectors), usable(queries)
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if not sizes or not sizes["dim"]:
        return None
    pivots = pivots_of(vectors, sizes["dim"], sizes["count"])
    asked = queries.mapInArrow(partial(_assign, pivots=pivots), "vec_id long, v binary, cell int, away double, norm double")
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("v", "cell", "away", "norm")).alias("q")).select("vec_id", "q.*")
    found = plan(vectors, asked, pivots, k)
    return None if found is None else (vectors, asked, found)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k highest integer inner products.

    Both tables have vec_id and embedding; components count as floor(64 * x). Pivots from the data divide both into
    Voronoi cells. A group is the queries of a cell. Summaries of the data (of each group the k + 1 best scores that all
    its queries are sure of, norms) give each group a score below which nothing counts; a row of data goes only to groups
    that may need it, by its own products with their pivots (see ``Bounds``). Neighbouring groups share a team, as far
    as that saves more than it wastes; tiles of a team and a chunk of the rows it needs are solved exactly, and their
    best are merged.

    Defined cases: a query is never its own result, nor are rows with its vec_id; ties go to the smaller vec_id; fewer
    candidates than k give all of them; vectors that are null or hold a null or non-finite component take no part, nor
    do rows without vec_id, vectors of another dimension than most (they have no product with these), and components so
    large that 64 times them is no finite double. Products are exact at any size; a score that no long can hold is at
    its end, and ties there. A repeated query id is answered once, for its vector that is smallest as bytes; repeated
    rows of data are results each; other columns are ignored; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    ready = prepared(vectors, queries, k)
    if ready is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors, asked, cut = ready
    teams = spark.createDataFrame(list(zip(range(len(cut.starts)), cut.parts, cut.chunks)), "team int, parts int, chunks int")  # a row a pivot at most
    team = np.searchsorted(cut.starts, np.arange(len(cut.bounds.groups.cells)), "right") - 1
    cells = spark.createDataFrame(list(zip(cut.bounds.groups.cells.tolist(), team.tolist())), "cell int, team int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(cells.join(teams, "team")), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    left = left.select("team", "part", every("chunks").alias("chunk"), "vec_id", "v")
    rows = vectors.mapInArrow(partial(_needed_by, bounds=cut.bounds, starts=cut.starts, k=k), "vec_id long, v binary, teams array<int>")
    right = rows.select("vec_id", "v", F.explode("teams").alias("team")).join(F.broadcast(teams), "team")
    right = right.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int")).select("team", every("parts").alias("part"), "chunk", "vec_id", "v")
    tile = ["team", "part", "chunk"]
    solve = partial(_solve, k=k, dim=cut.pivots.shape[1])
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

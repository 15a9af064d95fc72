"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

Two sets of similarity t or more have sizes within a factor t, and differ in at most (1-t)/(1+t) of their summed sizes.
Sets are put into bands of sizes; in a band, every set is cut into more parts (by element hash) than its partners can
differ in, so partners agree on a part: a tile is what shares band, part and the part's content. Parts that occur once
in the corpus are dropped by the packed counting of ``blocks``. Inside tiles, links are looked for between different
components only, so a dense group costs about as many checks as it has members. A part that more than TILE such sets
share, as a passage in very many documents makes, says too little: its sets are keyed anew by their rarest elements.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import blocks, words
from corpusloom.llm.components import components
from corpusloom.session import discard, prepare, stash

U = np.uint64
#: Bits of a set's signature, as 64-bit numbers.
SIGNATURE_LONGS = 16
#: Pairs below which all are checked at once, and rounds of checking one pair for each two components before tiles.
FEW_PAIRS, MOST_ROUNDS = 20_000, 2
#: Smallest keys of a set that travel with it, to tell in which shared part a pair is looked at.
SKETCH = 16
#: Elements that a part needs at most before it is a key.
MOST_LEAST = 8
#: Members of one side of a tile; sets that share a larger part are looked up again by their rarest elements.
TILE = 1024
#: Bits of an element's hash that name its slot in the order of rarity.
SLOT_BITS = 20


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 3 // 2))
    return np.array(out, np.int64)


#: Lower ends of the size bands, a factor 1.5 apart: partners are in the same band or one of the next.
BANDS = _edges()


def shingle_sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (A-Z in lower case), and n+1 offsets."""
    data, offsets = words.buffer(texts)
    found, sizes = [], []
    for i, j in words.spans_of_documents(offsets):
        part, at = words.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words.split(part, at)
        hashes, at = words.shingles(words.hashes(part, starts, ends), first, k)
        fresh = np.ones(len(hashes), bool)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            hashes[a:b].sort()
        fresh[1:] = hashes[1:] != hashes[:-1]
        fresh[at[:-1][at[:-1] < len(hashes)]] = True
        found.append(hashes[fresh])
        sizes.append(np.diff(np.concatenate([[0], np.cumsum(fresh)])[at]))
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return np.concatenate(found) if found else np.zeros(0, U), at.astype(np.int64)


def part_keys(tokens: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed (band, part, content) keys of all sets, and the set that each belongs to.

    A set is in its own band, and in the next ones where it is large enough for a partner there. With d the most elements
    that partners in a band can differ in, there are over d parts, so partners agree on one. Parts with few elements
    say little. A set of size n differs from a partner in n * (1-t)/t elements at most; it keeps only parts of m
    elements or more, with the largest m (up to MOST_LEAST) that leaves more parts than that, so it agrees with any
    partner on one of them. Of two partners the one with the smaller m has kept all parts of the other's m or more.
    """
    n = np.diff(at)
    doc = np.flatnonzero(n)
    band = np.searchsorted(BANDS, n[doc], "right") - 1
    if not len(doc):
        return np.zeros(0, U), np.zeros(0, np.int64)
    docs, bands, step = [doc], [band], 0
    while (also := 100 * n[doc] >= percent * BANDS[band + (step := step + 1)]).any():
        docs.append(doc[also])
        bands.append(band[also] + step)
    doc, band = np.concatenate(docs), np.concatenate(bands)
    most = BANDS[band + 1] - 1
    differ = 2 * most * (100 - percent) // (100 + percent)
    parts = differ + 1 + np.where(differ > 0, np.maximum(3, -(-(differ + 1) // 4)), 0)
    size = n[doc]
    begin = np.cumsum(size) - size
    element = tokens[np.repeat(at[doc] - begin, size) + np.arange(size.sum())]
    base = np.cumsum(parts) - parts
    part = ((element >> U(33)) * np.repeat(parts, size).astype(U)) >> U(31)
    slot = np.repeat(base, size) + part.astype(np.int64)
    value, total = words.mix(element + U(0x2545F4914F6CDD1D)), int(parts.sum())
    content = np.bincount(slot, (value & U(0xFFFFFFFF)).astype(np.float64), total).astype(U)
    content += np.bincount(slot, (value >> U(32)).astype(np.float64), total).astype(U) << U(32)
    count = np.bincount(slot, minlength=total)
    owner = np.repeat(np.arange(len(doc)), parts)
    label = (band[owner].astype(U) << U(40)) + (np.arange(total) - base[owner]).astype(U)
    keys = words.mix(words.mix(label + U(1)) ^ content) + count.astype(U)
    own = np.minimum(differ, size * (100 - percent) // percent)
    least = np.zeros(len(doc), np.int64)
    for m in range(1, MOST_LEAST + 1):
        least[np.add.reduceat((count >= m).astype(np.int64), base) > own] = m
    emit = count >= least[owner]
    return keys[emit], doc[owner[emit]]


def signature(tokens: np.ndarray) -> np.ndarray:
    """One bit for each element's hash."""
    bits = np.zeros(SIGNATURE_LONGS * 64, np.uint8)
    bits[(tokens & U(SIGNATURE_LONGS * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _keys_of(table: pa.Table, many: int, k: int, percent: int) -> list[np.ndarray]:
    return [part_keys(*shingle_sets(table["text"], k), percent)[0]]


def _describe(table: pa.Table, shared: np.ndarray, k: int, percent: int) -> pa.Table:
    tokens, at = shingle_sets(table["text"], k)
    keys, owner = part_keys(tokens, at, percent)
    keys, owner = keys[shared].view(np.int64), owner[shared]
    order = np.argsort(owner, kind="stable")
    keys, edges = keys[order], np.searchsorted(owner[order], np.arange(len(at)))
    digests, lists, bits = [], [], []
    for d in range(len(at) - 1):
        own = tokens[at[d] : at[d + 1]]
        digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
        if candidate := edges[d] < edges[d + 1]:
            lists.append(np.unique(keys[edges[d] : edges[d + 1]]))
        else:
            lists.append(None)
        bits.append(signature(own) if candidate else None)
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "copies": table["copies"],
            "text_md5": pa.array([hashlib.md5((t.as_py() or "").encode()).digest() for t in table["text"]], pa.binary()),
            "n_shingles": pa.array(np.diff(at)),
            "digest": pa.array(digests, pa.binary()),
            "keys": pa.array(lists, pa.list_(pa.int64())),
            "text": pc.if_else(pa.array([x is not None for x in bits]), table["text"], pa.scalar(None, pa.string())),
            "bits": pa.array(bits, pa.list_(pa.int64())),
        }
    )


def overlap_is_enough(overlap: Column, sizes: Column, percent: int) -> Column:
    """overlap / (sizes - overlap) >= percent / 100, in whole numbers."""
    return (100 + percent) * overlap >= percent * sizes


def _intersect(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose exact overlap suffices; the sets are made from the texts again, which are half their size."""
    for batch in batches:
        (x, x_at), (y, y_at) = shingle_sets(batch["text_a"], k), shingle_sets(batch["text_b"], k)
        keep = []
        for i in range(batch.num_rows):
            a, b = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            keep.append((100 + percent) * int((b[at] == a).sum()) >= percent * (len(a) + len(b)))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, differing) of the pairs whose bit counts allow a link: they bound the overlap from above."""
    for side in ("a", "b"):
        own = nodes.select(F.col("digest").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.join(own, side)
    differing = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    pairs = pairs.withColumn("differing", differing)
    sizes = F.col("n_a") + F.col("n_b")
    bound = F.floor((sizes - F.col("differing")) / 2)
    return pairs.where(overlap_is_enough(bound, sizes, percent)).select("a", "b", "differing")


def verify(pairs: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of their sorted arrays.

    Only texts of these pairs are moved; ids of up to BROADCAST_IDS documents are broadcast to select them.
    """
    pairs = stash(pairs.select("a", "b"), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = candidates.join(needed, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("digest").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.mapInArrow(partial(_intersect, k=k, percent=percent), "a binary, b binary")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with these."""
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a <> root_b")


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """The distinct pairs (a, b and what depends on these) that are not among the tested, in one aggregate of both."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.withColumn("old", F.lit(False)).unionByName(tested.select("a", "b", F.lit(True).alias("old")), allowMissingColumns=True)
    found = both.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in more], F.max("old").alias("old"))
    return found.where("NOT old").drop("old")


def together(
    pairs: DataFrame, edges: DataFrame, roots: DataFrame, candidates: DataFrame, k: int, percent: int, rounds: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, components and the pairs that still need a check, after rounds of one check for each two components.

    ``pairs`` has a, b, differing and the components root_a and root_b that these are in.

    A round checks the closest pair between any two components; pairs that its links bring together need no check.
    Rounds end when few pairs are left, when one finds no link, or at ``rounds``; what is left is not dropped but
    checked by the caller.
    """
    left = stash(pairs.select("a", "b", "differing", "root_a", "root_b"), "open")
    for _ in range(rounds):
        if left.count() <= FEW_PAIRS:
            break
        picked = left.groupBy(F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y")).agg(
            F.min_by(F.struct("a", "b"), F.struct("differing", "a", "b")).alias("p")
        )
        picked = stash(picked.select("p.a", "p.b"), "picked")
        found = stash(verify(picked, candidates, k, percent), "edges")
        rest = untested(left.select("a", "b", "differing"), picked)
        if not found.limit(1).count():
            left = rest
            break
        edges = edges.unionByName(found)
        roots = components(edges)
        before, left = left, stash(apart(rest, roots), "open")
        discard(before)
        discard(picked)
    return edges, roots, left.select("a", "b", "differing")


def _tile_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each tile whose bit counts allow a link; rows come sorted by tile.

    A pair shares many parts. It is left to the smallest one: a tile passes over it where the two sets' smallest keys
    show a smaller part that they share.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        key = np.stack([table[c].to_numpy() for c in ("key", "i", "j")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        yield from _pairs_of(table.slice(0, last), cuts, percent)
        rest = table.slice(last)
    if rest is not None:
        yield from _pairs_of(rest, np.array([rest.num_rows]), percent)


def _pairs_of(table: pa.Table, cuts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    begin = 0
    for end in cuts.tolist():
        part, begin = table.slice(begin, end - begin), end
        i, j, chunk = part["i"][0].as_py(), part["j"][0].as_py(), part["chunk"].to_numpy()
        bits = np.array(part["bits"].to_pylist(), np.int64).view(U)
        n = part["n"].to_numpy()
        roots = part["root"].to_pylist()
        root = np.unique(np.array(roots, object), return_inverse=True)[1]
        sketches = part["sketch"].to_pylist()
        key = part["key"][0].as_py()
        smaller = [frozenset(x for x in s if x < key) for s in sketches]
        digest = part["digest"].to_pylist()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        out = []
        for x in left.tolist():
            y = right[right > x] if i == j else right
            y = y[root[y] != root[x]]
            differing = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
            sizes = n[y] + n[x]
            fits = (100 + percent) * ((sizes - differing) // 2) >= percent * sizes
            for z, n_z in zip(y[fits].tolist(), differing[fits].tolist()):
                if not smaller[x].isdisjoint(smaller[z]):
                    continue  # the pair meets in its smallest shared part
                p, q = (x, z) if digest[x] < digest[z] else (z, x)
                out.append((digest[p], digest[q], n_z, roots[p], roots[q]))
        if out:
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            yield pa.record_batch(columns, names=["a", "b", "differing", "root_a", "root_b"])


def in_components(member: DataFrame, roots: DataFrame) -> DataFrame:
    """``member`` (digest, key) with each set's component."""
    placed = member.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    return placed.withColumn("root", F.coalesce("root", "digest"))


def mixed(placed: DataFrame) -> DataFrame:
    """(key, size, chunks) of keys with members of different components; of keys with the same members the smallest."""
    members = [F.expr("bit_xor(xxhash64(digest))").alias("x"), F.expr("sum(cast(crc32(digest) as long))").alias("y")]
    keys = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"), *members)
    keys = keys.where("r0 <> r1").groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    return keys.select("key", "size", F.ceil(F.col("size") / TILE).cast("int").alias("chunks"))


def tile_pairs(keys: DataFrame, placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, differing, root_a, root_b): pairs of different components that share one of ``keys`` and may link."""
    sides = (
        placed.join(keys.select("key", "chunks"), "key")
        .join(nodes.select("digest", "n", "bits", F.slice("keys", 1, SKETCH).alias("sketch")), "digest")
        .withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .select("key", "i", "j", "chunk", "digest", "root", "n", "bits", "sketch")
    )
    tiled = sides.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "digest")
    return tiled.mapInArrow(partial(_tile_pairs, percent=percent), "a binary, b binary, differing int, root_a binary, root_b binary")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(64 - SLOT_BITS)).astype(np.int64)


def _count_slots(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_slots(shingle_sets(batch["text"], k)[0]), minlength=len(counts))
    full = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(full), pa.array(counts[full])], names=["slot", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], k: int, percent: int, counts: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, at = shingle_sets(batch["text"], k)
        lists = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = tokens[a:b]
            order = np.lexsort((own, counts.value[_slots(own)]))
            lists.append(np.sort(own[order[: (b - a) * (100 - percent) // 100 + 1]].view(np.int64)))
        yield pa.record_batch([batch["digest"], pa.array(lists, pa.list_(pa.int64()))], names=["digest", "keys"])


def rare_elements(crowd: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """(digest, keys): the first elements of each set of ``crowd``, in an order that puts rare ones first.

    A set of size n has at least t * n elements in common with a partner, so the first of the common ones is among its
    first n - t * n + 1, and likewise among the partner's: partners share a key, whatever the order. So it need not be
    exact: elements go by how many of the crowd's elements are in their slot of 2**SLOT_BITS, then by their hash. That
    table of 8 MB, whatever the input, is all that is broadcast. What a common passage fills comes last.
    """
    if crowd.count() <= BROADCAST_IDS:
        crowd = F.broadcast(crowd)
    texts = candidates.join(crowd, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    texts = stash(texts, "crowd")
    found = texts.select("text").mapInArrow(partial(_count_slots, k=k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    order = texts.sparkSession.sparkContext.broadcast(counts)
    return stash(texts.mapInArrow(partial(_rarest, k=k, percent=percent, counts=order), "digest binary, keys array<long>"), "rare")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Words are runs of other bytes than space and 0x09-0x0D, A-Z in lower case; a document's set is its distinct k-word
    shingles, or its whole run of words where it has fewer than k. Documents link when 100 * common >= percent * union.
    component_id is the smallest doc_id that links reach, the document's own included.

    Defined cases: without words the set is empty and links with nothing; equal sets always link; a null doc_id takes
    part in links but is never a component_id unless the component has no other; repeated rows are documents of their
    own; columns besides doc_id and text are ignored; an empty table gives an empty result. Element hashes have 64
    bits; comparisons are between the sets of a pair, so a false equality has a chance of about n * n / 2**64.
    """
    light = linked(docs, k, percent)
    smallest = light.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # a table of its own, so that rows of a large component are dealt to several tasks of the join
    return light.join(stash(smallest, "smallest"), "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_md5, n_shingles, root) of each row; root names its component, null where its set is empty."""
    prepare(docs.sparkSession)
    rows = blocks.different(docs)
    schema = "doc_id long, copies long, text_md5 binary, n_shingles long, digest binary, keys array<long>, text string, bits array<long>"
    share = 1.6 * 2 * (100 - percent) / (100 + percent) * 1.15
    found = blocks.with_repeats(
        rows.dealt(),
        partial(_keys_of, k=k, percent=percent),
        partial(_describe, k=k, percent=percent),
        schema,
        rows.bytes,
        int(rows.bytes / 6 * share) + 1,
        width=4,
    )
    found = stash(found, "sets")
    candidates = found.where("keys IS NOT NULL")
    nodes = candidates.groupBy("digest").agg(
        F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys")
    )
    nodes = stash(nodes, "nodes")
    member = nodes.select("digest", F.explode("keys").alias("key"))

    # the smallest and the largest member of each part against all its others: first each one's closest, then the
    # closest pair of any two components, so that what links is soon together and the rest need not be compared
    ends = member.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    shared = member.join(ends, "key")
    stars = [shared.where(F.col("digest") != F.col(end)).select(F.col("digest").alias("a"), F.col(end).alias("b")) for end in ("low", "high")]
    stars = stash(close(stars[0].unionByName(stars[1]).distinct(), nodes, percent), "stars")
    closest = stars.groupBy("a").agg(F.min_by("b", F.struct("differing", "b")).alias("b"))
    edges = stash(verify(closest, candidates, k, percent), "edges")
    roots = components(edges)
    done = closest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "differing")
    edges, roots, open_ = together(apart(untested(tested, done), roots), edges, roots, candidates, k, percent, MOST_ROUNDS)

    # then what is still in different components
    placed = in_components(member, roots)
    parts = stash(mixed(placed).where("size > 3"), "parts")
    tiles = tile_pairs(parts.where("chunks = 1"), placed, nodes, percent)
    crowded = parts.where("chunks > 1")
    if crowded.limit(1).count():
        crowd = stash(placed.join(crowded.select("key"), "key", "left_semi").select("digest").distinct(), "crowd")
        rare = nodes.drop("keys").join(rare_elements(crowd, candidates, k, percent), "digest")
        placed = in_components(rare.select("digest", F.explode("keys").alias("key")), roots)
        tiles = tiles.unionByName(tile_pairs(stash(mixed(placed), "parts"), placed, rare, percent))
    rest = apart(open_, roots).unionByName(untested(tiles, tested))
    edges, roots, open_ = together(rest, edges, roots, candidates, k, percent, 1)
    more = stash(verify(open_, candidates, k, percent), "edges")
    if more.limit(1).count():
        roots = components(edges.unionByName(more))

    light = rows.expanded(found.select("doc_id", "copies", "text_md5", "n_shingles", "digest"))
    light = light.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    return light.select("doc_id", "text_md5", "n_shingles", F.coalesce("root", "digest").alias("root"))


#: Ids (some 60 bytes each) up to which a join may broadcast them; beyond, it shuffles both sides.
BROADCAST_IDS = 500_000


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each component of ``ngram_join`` left.

    That is the row with the smallest doc_id (null counts as largest), then the smallest MD5 of its text, then, among
    rows repeating both, the smallest SHA-256 of the row as JSON. Rows go, not ids: where a doc_id is repeated with
    different texts, each text is judged by its own component. All columns are carried, whatever their names; texts
    without words are in no component and stay; an empty table gives an empty result.
    """
    rows = linked(docs, k, percent).where("root IS NOT NULL")
    each = stash(rows.groupBy("root", "doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n")), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_md5", "n")).alias("first")
    kept = each.groupBy("root").agg(first, F.sum("n").alias("rows")).where("rows > 1")
    kept = small(stash(kept.select("root", "first"), "kept"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_md5") == F.col("first.text_md5"))
    gone = stash(each.join(kept, "root").where(~same).select("doc_id", "text_md5"), "gone")
    again = stash(kept.where("first.n > 1").select("first.doc_id", "first.text_md5"), "again")
    left = by_row(docs, small(gone), "left_anti")
    if not again.limit(1).count():
        return left
    again = small(again)
    row = F.struct(*docs.columns)
    one = by_row(left, again, "left_semi").groupBy(*map(row_key, ("doc_id", "text"))).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row"))
    return by_row(left, again, "left_anti").unionByName(one.select("row.*"))


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast where its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def row_key(name: str) -> Column:
    return F.col(name).cast("long") if name == "doc_id" else F.unhex(F.md5(F.col(name).cast("string")))


def by_row(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are (or are not) among ``keys``, under names that clash with no column."""
    taken, key, text = {c.lower() for c in docs.columns}, "k", "t"
    while key in taken or text in taken:
        key, text = key + "_", text + "_"
    keys = keys.select(F.col("doc_id").alias(key), F.col("text_md5").alias(text))
    return docs.join(keys, row_key("doc_id").eqNullSafe(F.col(key)) & (row_key("text") == F.col(text)), how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(list_slice(words, i, i + 2), ' ')) ELSE [array_to_string(words, ' ')] END) AS g
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

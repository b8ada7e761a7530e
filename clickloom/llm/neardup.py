"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification.

The order of work, each step distributed and none of it all-pairs:

1. Every text becomes its set of five-word shingles and 64 band keys from MinHash values.
2. Documents with equal sets are folded into the one with the smallest id.
3. Documents that share a band key get a longer signature. A bucket (documents that share a band key) compares all members with its smallest member, the
   hub. A pair is compared in batches of signature bytes and given up as soon as the posterior
   probability that its similarity reaches the threshold falls below ``MISS``. Survivors are
   verified on full sets. Groups of copies collapse here, with one link per member.
4. Buckets whose members still lie in different components compare the rest of their members, cut
   into tiles of bounded size. A tile holds signatures, returns only surviving pairs from
   different components, and leaves a pair to the first band in which it meets.
5. Links that pass verification give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import (
    Scratch,
    bitmap_of,
    bound_batches,
    by_group,
    materialize,
    maybe_column,
    maybe_in,
    pick,
    row_keys,
    split_join,
    where_maybe,
)
from clickloom.llm.components import connected
from clickloom.llm.words import hashed_words, mix, shingles, stream

BANDS = 64
BAND_ROWS = 6
HASHES = 1024  # length of the signature of a document that shares a band key
STEP = 32  # signature bytes compared between two looks at the posterior
MISS = 1e-5  # chosen probability of giving up a pair that does reach the threshold, per look
TILE = 1024  # documents of one bucket in one block
TILE_BYTES = 2 << 20  # shingle sets in one block of the exact check
PERCENT = 75

def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    high = (stream(seed, 2 * n) >> np.uint64(32)).astype(np.uint32)
    return high[:n] | np.uint32(1), high[n:]


_BAND_HASHES = _functions(11, BANDS * BAND_ROWS)
_HASHES = _functions(12, HASHES)

SKETCH = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"


def minima(shingle_set: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    slope, shift = functions
    high = (shingle_set >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(slope), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(high), 256):  # keeps the product in cache and its size bounded
        np.minimum(low, (high[start : start + 256, None] * slope + shift).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = low.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, key_a, key_b, bands = [], [], [], []
        for words in hashed_words(batch.column("text").to_pylist()):
            own = np.unique(shingles(words))
            sizes.append(len(own))
            key_a.append(own.sum(dtype=np.uint64))
            key_b.append(mix(own).sum(dtype=np.uint64))
            bands.append(band_keys(minima(own, _BAND_HASHES)).view(np.int64) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(key_a, np.uint64).view(np.int64)),
                pa.array(np.array(key_b, np.uint64).view(np.int64)),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "key_a", "key_b", "bands"],
        )


def _members(keys):
    """(key, band, id) of each band key that more than one document may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
                row, band = np.nonzero(maybe_in(keys.value, own))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[row, band]),
                        pa.array(band.astype(np.int32)),
                        batch.column("id").take(pa.array(row)),
                    ],
                    names=["key", "band", "id"],
                )

    return run


def _sets(active):
    """Shingle set and signature of each text whose id may be active."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(maybe_in(active.value, batch.column("id").to_numpy())))
            sets = [np.unique(shingles(w)) for w in hashed_words(batch.column("text").to_pylist())]
            signatures = [minima(s, _HASHES).astype(np.uint8).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["id", "own", "signature"],
            )

    return run


@lru_cache
def least_matches(length: int, percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """For each look: the fewest equal bytes with which a pair is kept.

    With a uniform prior on the probability p that two signature bytes are equal, m matches among
    n leave p Beta(m + 1, n - m + 1), and P(p >= t) = P(Binomial(n + 1, t) <= m). A byte also
    agrees by chance, so t = J + (1 - J) / 256 for the similarity J at the threshold.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    kept = []
    for n in range(STEP, length + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += float(
                np.exp(
                    lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 2)
                    + m * log(t) + (n + 1 - m) * log(1 - t)
                )
            )
            if below >= miss:
                break
            m += 1
        kept.append(m)
    return tuple(kept)


def surviving(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the row pairs that no look gives up; both sides are arrays of signature bytes."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for look, fewest in enumerate(least_matches(left.shape[1], percent)):
        part = slice(look * STEP, (look + 1) * STEP)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
        keep = matches >= fewest
        alive, matches = alive[keep], matches[keep]
    return alive


def _bytes(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _prune_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = _bytes(batch.column("sig_a"), np.uint8, HASHES)
                right = _bytes(batch.column("sig_b"), np.uint8, HASHES)
                yield batch.select(["a", "b"]).take(pa.array(surviving(left, right, percent)))

    return run


def _compare_tile(percent: int):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        ids = table.column("id").to_numpy()
        roots, blocks = table.column("root").to_numpy(), table.column("block").to_numpy()
        hub = table.column("hub")[0].as_py()
        low, high, band = (table.column(c)[0].as_py() for c in ("low", "high", "band"))
        sigs = _bytes(table.column("signature"), np.uint8, HASHES)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        lefts, rights = [], []
        for i in range(len(ids) - 1):
            other = np.arange(i + 1, len(ids))
            fit = (roots[other] != roots[i]) & (ids[other] != hub) & (ids[i] != hub)
            if low != high:
                fit &= blocks[other] != blocks[i]
            other = other[fit]
            if band and len(other):
                other = other[~(keys[other, :band] == keys[i, :band]).any(axis=1)]
            if len(other):
                one = np.broadcast_to(sigs[i], (len(other), HASHES))
                other = other[surviving(one, sigs[other], percent)]
                lefts.append(np.full(len(other), ids[i]))
                rights.append(ids[other])
        if not lefts:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(lefts), pa.int64()), pa.array(np.concatenate(rights), pa.int64())],
            names=["a", "b"],
        )

    return by_group(work, ["key", "low", "high"])


def reaches(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets satisfy 100 * intersection >= percent * union."""
    if len(left) > len(right):
        left, right = right, left
    if 100 * len(left) < percent * len(right):
        return False
    at = np.searchsorted(right, left)
    both = int((right[np.minimum(at, len(right) - 1)] == left).sum())
    return 100 * both >= percent * (len(left) + len(right) - both)


def _verify_tile(percent: int):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        held: dict[int, list[np.ndarray]] = {}
        pairs = []
        rows = table.select(["id", "other", "own"]).to_pydict()
        for one, other, own in zip(*rows.values(), strict=True):
            if own is None:
                pairs.append((one, other))
            else:
                held.setdefault(one, []).append(np.frombuffer(own, np.uint64))
        good = [
            (a, b)
            for a, b in pairs
            if any(reaches(x, y, percent) for x in held.get(a, ()) for y in held.get(b, ()))
        ]
        return pa.RecordBatch.from_pylist(
            [{"a": a, "b": b} for a, b in good],
            schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]),
        )

    return by_group(work, ["low", "high"])


def verify(pairs: DataFrame, sets: DataFrame, blocks: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full sets.

    Ids are dealt to blocks of bounded bytes; a set travels once to each tile (a pair of blocks)
    that has a pair of it, not once per pair.
    """
    dealt = pairs.select(
        "a",
        "b",
        F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("x"),
        F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("y"),
    ).select("a", "b", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))
    dealt = materialize(dealt, "pairs")
    lefts = dealt.select("low", "high", F.col("a").alias("id")).distinct()
    rights = dealt.select("low", "high", F.col("b").alias("id")).distinct()
    ends = materialize(lefts.union(rights).distinct(), "pair-ends")
    sets = where_maybe(sets.select("id", "own"), "id", bitmap_of(ends.select("id"), "id"))
    rows = ends.join(sets, "id").select("low", "high", "id", F.lit(None).cast("long").alias("other"), "own")
    rows = rows.unionByName(
        dealt.select(
            "low", "high", F.col("a").alias("id"), F.col("b").alias("other"),
            F.lit(None).cast("binary").alias("own"),
        )
    )
    return (
        rows.repartition("low", "high")
        .sortWithinPartitions("low", "high")
        .mapInArrow(_verify_tile(percent), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of five-word
    shingles (a text of fewer words is one shingle); component_id is the smallest id reachable.

    Edge cases: a null or blank text has an empty set and is linked with nothing. Rows with one
    id are one node, each with its own n_shingles. A row without an id is linked with nothing,
    its component_id is null and it is kept. Repeated rows give repeated rows; an empty table an
    empty result. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, text=text_col)
    every = scratch.store(texts.mapInArrow(_sketch, SKETCH), "sketches")
    sizes = materialize(every.select("doc_id", "n_shingles"), "sizes")
    full = every.where("n_shingles > 0 and doc_id is not null")

    set_key = ["n_shingles", "key_a", "key_b"]
    folded = (
        full.groupBy(*set_key)
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
    )
    copies = scratch.store(
        split_join(full.select("doc_id", *set_key), folded, set_key, "inner", "folded")
        .where("doc_id > first")
        .select("doc_id", "first", *set_key),
        "copies",
    )
    doubtful = bitmap_of(copies.select("doc_id"), "doc_id")
    banded = full.select("doc_id", *set_key, "bands")
    heads = where_maybe(banded, "doc_id", doubtful, wanted=False).union(
        where_maybe(banded, "doc_id", doubtful).join(
            copies.select("doc_id", *set_key), ["doc_id", *set_key], "left_anti"
        ).select(*banded.columns)
    ).select(F.col("doc_id").alias("id"), "bands")

    buckets = (
        heads.select("id", F.explode("bands").alias("key"))
        .groupBy("key")
        .agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("hub < last")
        .drop("last")
    )
    buckets = scratch.store(buckets, "buckets")
    shared = heads.mapInArrow(_members(bitmap_of(buckets, "key")), "key long, band int, id long")
    members = scratch.store(shared.join(buckets, "key"), "members")
    scratch.drop("buckets")
    active = bitmap_of(members, "id")
    known = texts.where("doc_id is not null").withColumnRenamed("doc_id", "id").withColumn("id", F.col("id").cast("long"))
    sets = scratch.store(known.mapInArrow(_sets(active), "id long, own binary, signature binary"), "sets")
    sigs = sets.where("signature is not null").select("id", "signature").dropDuplicates()
    total = sets.agg(F.sum(F.length("own"))).first()[0] or 0
    blocks = max(1, ceil(total / TILE_BYTES))

    def of(end: str) -> DataFrame:
        return sigs.select(F.col("id").alias(end), F.col("signature").alias(f"sig_{end}"))

    to_hub = scratch.store(members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "hub-pairs")
    likely = to_hub.join(of("b"), "b").join(of("a"), "a").mapInArrow(_prune_pairs(percent), "a long, b long")
    first_links = scratch.store(verify(likely, sets, blocks, percent), "hub-links")
    scratch.drop("hub-pairs")
    roots = scratch.store(connected(first_links), "hub-roots")

    placed = members.where("n > 2").join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.withColumn("root", F.coalesce("root", "id"))
    split = (
        placed.groupBy("key")
        .agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
        .where("r0 < r1")
        .select("key")
    )
    blocks_of = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.hash("id"), blocks_of).cast("int")
    tiled = (
        split_join(placed, split, ["key"], "inner", "open-buckets")
        .withColumn("block", own)
        .select(
            "key", "band", "id", "root", "hub", "block",
            F.explode(F.sequence(F.lit(0), blocks_of - 1)).alias("with"),
        )
        .select(
            "key", "band", "id", "root", "hub", "block",
            F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        )
    )
    held = where_maybe(heads, "id", active).select("id", "bands").join(sigs, "id")
    tiles = scratch.store(tiled, "tiles")
    scratch.drop("members", "hub-roots")
    compared = (
        tiles.join(held, "id")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
        .mapInArrow(_compare_tile(percent), "a long, b long")
    )
    more_links = scratch.store(verify(compared, sets, blocks, percent), "links")
    scratch.drop("tiles", "sets", "sketches")

    near = first_links.union(more_links).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.store(near.union(copies.select("doc_id", "first").distinct()), "all-links")
    scratch.drop("hub-links", "links", "copies")
    final = materialize(connected(links), "roots").withColumnsRenamed({"node": "doc_id", "root": "reached"})
    scratch.drop("all-links")
    component = F.coalesce("reached", "doc_id")
    return (
        sizes.join(final, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id.

    All columns are kept as they are. Rows that agree in all columns shrink to one if they have an
    id; rows that share an id and differ in any column all stay or go with that id. Rows without
    an id stay, also repeated ones. Null and blank texts stay; an empty table gives an empty one;
    columns of other names are only carried.

    Texts do not move for rows that surely stay: a bitmap of the ids that go or come twice picks
    the few rows that enter the exact steps.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    key = f"`{id_col}`"
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = docs.select(F.col(key).cast("long").alias("_id"), *row_keys(*docs.columns)).where(F.col("_id").isNotNull())
    repeated = rows.groupBy("_id", "row_a", "row_b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id").distinct()
    unsure = bitmap_of(gone.select(F.col("_gone").alias("_id")).union(repeated), "_id")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    known = docs.select(F.col(key).cast("long").alias("_id"), whole, *row_keys(*docs.columns)).where(F.col("_id").isNotNull())
    marked = known.withColumn("_unsure", maybe_column(F.col("_id"), unsure))
    doubtful = marked.where("_unsure").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    kept = marked.where("not _unsure").select("_row").union(doubtful.dropDuplicates(["_id", "row_a", "row_b"]).select("_row"))
    return kept.select("_row.*").unionByName(docs.where(F.col(key).isNull()))

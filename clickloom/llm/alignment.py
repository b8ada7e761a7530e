"""Which tokens of two tokenizers stand for the same bytes, and how many documents link a pair.

A byte-level BPE file (A) and a sentencepiece model (B) cut the same text. Offsets where both have a
token end cut a text into groups; tokens of a group are linked. Links are counted by an inverted
index:

1. A task numbers its documents and holds, per id pair, which of them link it. When a bounded number
   of entries is held or a container (65,536 document numbers) is full, the entries of all slices
   are merged by OR into one compressed bitmap per pair (sorted 16-bit numbers, or bits once those are
   shorter) and leave the task with their popcount. Pairs linked several times in a document also
   have multiplicity planes: plane k marks the documents whose count less one has bit k.
2. Popcounts add up over containers, folded before the shuffle, to a pair's document count. Bitmaps
   of indexes that share containers are merged by OR first (``postings_of``).
3. The postings carry the counts back: joined with their pair's count, they go to their container,
   where every document adds up what its pairs bring.

No step gathers a pair or a document collection in one task: sums fold before they are shuffled, an
oversized pair is cut by the skewed join, and a container is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import bound_batches, materialize
from clickloom.llm.streambpe import encoded_parts, vocabulary_of
from clickloom.llm.words import SLICE_BYTES

CONTAINER = 1 << 16  # documents in one container
BITSET = CONTAINER // 8  # bytes; as many sorted 16-bit numbers are never stored
HELD_ENTRIES = 1 << 22  # (pair, document) entries a task holds before their bitmaps leave
LARGE_GROUP = 1 << 12  # links of a group from which its ids are counted before they are paired
OUT_ROWS = 1 << 16
DOCS = -1  # the plane that holds the documents themselves

SCHEMA = pa.schema([
    ("container", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("bits", pa.binary()), ("n", pa.int64()),
])
DDL = ("container long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "a int, b int, plane int, bits binary, n long")
POSTING = "a int, b int, container long, plane int, n long, bits binary"
SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


class Aligned(NamedTuple):
    """What some texts give: a row of counts and a digest for each, and all their linked pairs."""

    rows: list[tuple]  # n_a, n_b, n_groups, n_links, groups_sha256
    codes: np.ndarray  # pairs, A id in the upper half
    times: np.ndarray  # how often each entry's pair is linked
    texts: np.ndarray  # the entry's text, by its place in the list


def _keeps_text(model) -> bool:
    """Whether a sentencepiece model neither normalises text nor drops white space."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).normalizer_spec
    return spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = vocabulary_of(a_path)
        self.a_bytes = [self.a.text.get(n, b"") for n in range(max(self.a.text) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.as_is = _keeps_text(self.b)
        self.b_bytes = [self._piece_bytes(n) for n in range(self.b.get_piece_size())]
        self.a_lengths = np.array([len(t) for t in self.a_bytes])
        self.b_lengths = np.array([len(t) for t in self.b_bytes])
        # a token's number with what follows it: for an id k, 2k inside its group and 2k + 1 at the end
        self.written = [b"%d%b" % (n, mark) for n in range(len(self.a_bytes)) for mark in (b",", b"|")]
        self.written += [b"%d%b" % (n, mark) for n in range(len(self.b_bytes)) for mark in (b",", b";")]

    def _piece_bytes(self, n: int) -> bytes:
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()

    def _gives_back(self, b: np.ndarray, raw: bytes) -> bool:
        """Whether B's tokens are the bytes of the text.

        A model that keeps texts as they are only ever turns U+2581 into a space, which shows in
        the length, or a character into the unknown token.
        """
        if self.as_is:
            return int(self.b_lengths[b].sum()) == len(raw) and not (b == self.b.unk_id()).any()
        return b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw

    def aligned(self, texts: list[str | None]) -> Aligned:
        """Align some texts at once: their tokens lie one after another in flat arrays."""
        some = [k for k, t in enumerate(texts) if t]
        b_ids = self.b.encode([texts[k] for k in some], num_threads=1) if some else []
        whole, a_parts, b_parts, sizes = [], [], [], []
        for k, b in zip(some, b_ids, strict=True):
            raw = (" " + texts[k]).encode()
            a = np.frombuffer(b"".join(encoded_parts(self.a, " " + texts[k], plain=True)), "<u4")
            b = np.array(b, np.int64)
            if int(self.a_lengths[a].sum()) == len(raw) and self._gives_back(b, raw):
                whole.append(k)
                a_parts.append(a)
                b_parts.append(b)
                sizes.append(len(raw))
        rows = [(0, 0, 0, 0, "")] * len(texts)
        if not whole:
            none = np.zeros(0, np.int64)
            return Aligned(rows, none, none, none)
        a, b = np.concatenate(a_parts).astype(np.int64), np.concatenate(b_parts)
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        both = np.zeros(a_ends[-1] + 1, bool)
        both[a_ends] = True
        ends = b_ends[both[b_ends]]  # where groups end
        before = np.zeros(a_ends[-1] + 2, np.int64)
        before[ends + 1] = 1
        np.cumsum(before, out=before)  # groups that end before an offset
        a_group, b_group = before[a_ends], before[b_ends]
        n_a, n_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b

        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + b_first[a_group]] = 2 * a + (np.diff(a_group, append=len(ends)) > 0)
        b_shown = 2 * (b + len(self.a_bytes)) + (np.diff(b_group, append=len(ends)) > 0)
        shown[np.arange(len(b)) + (a_first + n_a)[b_group]] = b_shown
        links = np.append(0, np.cumsum(n_a * n_b))
        text_ends = np.searchsorted(ends, np.cumsum(sizes), "right")  # groups up to the end of each text
        a_upto, b_upto = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        first = 0
        for k, last in zip(whole, text_ends.tolist(), strict=True):
            own_a, own_b = int(a_upto[last] - a_upto[first]), int(b_upto[last] - b_upto[first])
            at = int(a_upto[first] + b_upto[first])
            text = b"".join(map(self.written.__getitem__, shown[at : at + own_a + own_b].tolist()))
            rows[k] = (own_a, own_b, last - first, int(links[last] - links[first]), hashlib.sha256(text[:-1]).hexdigest())
            first = last
        owner = np.repeat(np.array(whole), np.diff(text_ends, prepend=0))  # the text of each group
        return Aligned(rows, *_linked(a, b, a_group, n_a, n_b, a_first, b_first, owner))


def _linked(a, b, a_group, n_a, n_b, a_first, b_first, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all groups: every A token with every B token; large groups by distinct ids."""
    large = n_a * n_b > LARGE_GROUP
    repeats = np.where(large, 0, n_b)[a_group]
    inside = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    codes = [np.repeat(a, repeats) << 32 | b[np.repeat(b_first[a_group], repeats) + inside]]
    times, texts = [np.ones(len(codes[0]), np.int64)], [np.repeat(owner[a_group], repeats)]
    for g in np.flatnonzero(large):
        xs, m = np.unique(a[a_first[g] : a_first[g] + n_a[g]], return_counts=True)
        ys, n = np.unique(b[b_first[g] : b_first[g] + n_b[g]], return_counts=True)
        codes.append((xs[:, None] << 32 | ys).reshape(-1))
        times.append((m[:, None] * n).reshape(-1))
        texts.append(np.full(len(codes[-1]), owner[g]))
    return np.concatenate(codes), np.concatenate(times), np.concatenate(texts)


@lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def compressed(slots: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One bitmap for each run of sorted slots: 16-bit numbers, or bits where those are shorter."""
    sizes = np.diff(ends, prepend=0)
    words = slots.astype("<u2")
    large = np.flatnonzero(2 * sizes >= BITSET)
    if len(large):
        parts, at = [], 0
        for k in large:
            first = ends[k] - sizes[k]
            bits = np.zeros(CONTAINER, np.uint8)
            bits[words[first : ends[k]]] = 1
            parts += [words[at:first], np.packbits(bits, bitorder="little").view("<u2")]
            at = ends[k]
        words = np.concatenate([*parts, words[at:]])
        sizes[large] = BITSET // 2
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(2 * sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(words)])


def slots_of(bits: bytes) -> np.ndarray:
    """The document numbers of one compressed bitmap."""
    if len(bits) < BITSET:
        return np.frombuffer(bits, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype("<u2")


def merged_bits(parts: list[bytes]) -> bytes:
    """The OR of compressed bitmaps."""
    slots = np.unique(np.concatenate([slots_of(p) for p in parts]))
    return compressed(slots, np.array([len(slots)]))[0].as_py()


class _Held:
    """Entries of the current container, until their bitmaps leave.

    An entry is one number, pair and document, so that sorting numbers sorts entries.
    """

    def __init__(self, b_size: int):
        self.container = TaskContext.get().partitionId() << 32
        self.b_size, self.slot, self.n = b_size, 0, 0
        self.keys, self.extra = [], []

    def add(self, found: Aligned) -> None:
        pairs = (found.codes >> 32) * self.b_size + (found.codes & 0xFFFFFFFF)
        keys = pairs * CONTAINER + found.texts + self.slot
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys.append(keys[first])
        self.extra.append(np.add.reduceat(found.times[order], first) - 1 if len(first) else found.times)
        self.n += len(first)
        self.slot += len(found.rows)

    def leave(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            self.container, self.slot = self.container + 1, 0
            return
        keys, extra = np.concatenate(self.keys), np.concatenate(self.extra)
        order = np.argsort(keys)
        keys, extra = keys[order], extra[order]
        yield from self._plane(keys, DOCS)
        for k in range(int(extra.max()).bit_length()):
            yield from self._plane(keys[extra >> k & 1 == 1], k)
        self.keys, self.extra, self.n = [], [], 0
        self.container, self.slot = self.container + 1, 0

    def _plane(self, keys: np.ndarray, plane: int) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        pairs = keys // CONTAINER
        ends = np.append(np.flatnonzero(np.diff(pairs)) + 1, len(pairs))
        own = pairs[ends - 1]
        bits, n_docs = compressed(keys % CONTAINER, ends), np.diff(ends, prepend=0)
        for k in range(0, len(own), OUT_ROWS):
            part = own[k : k + OUT_ROWS]
            n = len(part)
            yield _batch({
                "container": np.full(n, self.container), "a": (part // self.b_size).astype(np.int32),
                "b": (part % self.b_size).astype(np.int32), "plane": np.full(n, plane, np.int32), "bits": bits.slice(k, n),
                "n": n_docs[k : k + n],
            }, n)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE_BYTES`` characters, one longer text alone."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= SLICE_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array)
         else columns.get(f.name, pa.nulls(n, f.type)) for f in SCHEMA],
        schema=SCHEMA,
    )


def index_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", held_entries: int = HELD_ENTRIES
) -> DataFrame:
    """The stored index: a row per document (``a`` null) and the bitmap parts of every pair.

    ``held_entries`` bounds a task's memory; the result does not depend on it.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(a_path, b_path)
        held = _Held(len(both.b_bytes))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, last in _slices(texts):
                if held.slot + last - first > CONTAINER:
                    yield from held.leave()
                found = both.aligned(texts[first:last])
                n = last - first
                columns = dict(zip(SCHEMA.names[3:8], map(list, zip(*found.rows, strict=True)), strict=True))
                columns |= {"container": np.full(n, held.container), "slot": held.slot + np.arange(n), "doc_id": ids.slice(first, n)}
                yield _batch(columns, n)
                held.add(found)
                if held.n >= held_entries:
                    yield from held.leave()
        yield from held.leave()

    return materialize(own.mapInArrow(run, DDL), "pair-index")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair, container and plane: OR equal ones together, add the popcount."""
    key = ["a", "b", "container", "plane"]
    names = [*key, "bits"]
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch.select(names)])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in key]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.append(0, np.flatnonzero(change) + 1)
        held = table.slice(starts[-1])  # may go on in the next batch
        if len(starts) > 1:
            yield _or_runs(table.slice(0, starts[-1]), starts, key)
    if held is not None and held.num_rows:
        yield _or_runs(held, np.array([0, held.num_rows]), key)


def _or_runs(table: pa.Table, starts: np.ndarray, key: list[str]) -> pa.RecordBatch:
    edges = np.unique(np.append(starts[starts < table.num_rows], table.num_rows))
    first, sizes = edges[:-1], np.diff(edges)
    bits = table.column("bits").combine_chunks()
    bits = bits if isinstance(bits, pa.Array) else bits.chunk(0)
    out = bits.take(pa.array(first))
    if (sizes > 1).any():
        whole = out.to_pylist()
        for k in np.flatnonzero(sizes > 1):
            whole[k] = merged_bits(bits.slice(first[k], sizes[k]).to_pylist())
        out = pa.array(whole, pa.binary())
    length = np.diff(np.frombuffer(out.buffers()[1], np.int32)[out.offset : out.offset + len(out) + 1])
    n = length.astype(np.int64) // 2
    for k in np.flatnonzero(length >= BITSET):
        n[k] = int(np.unpackbits(np.frombuffer(out[int(k)].as_py(), np.uint8)).sum())
    kept = table.select(key).take(pa.array(first))
    columns = {name: kept.column(name).combine_chunks() for name in key} | {"n": pa.array(n, pa.int64()), "bits": out}
    return pa.RecordBatch.from_pydict({name: columns[name] for name in ("a", "b", "container", "plane", "n", "bits")})


def postings_of(index: DataFrame) -> DataFrame:
    """The stored postings: one bitmap per pair, container and plane, with its popcount ``n``."""
    key = ["a", "b", "container", "plane"]
    parts = index.where(F.col("a").isNotNull()).select(*key, "bits")
    return materialize(parts.repartition("a", "b", "container").sortWithinPartitions(*key).mapInArrow(_counted, POSTING), "postings")


def pair_counts(postings: DataFrame) -> DataFrame:
    """Per id pair: in how many documents it is linked, how often, and whether that number of
    documents is the highest of its A id (ties included)."""
    is_docs = F.col("plane") == DOCS
    weight = F.when(is_docs, F.lit(1)).otherwise(F.expr("shiftleft(1L, greatest(plane, 0))"))
    sums = postings.groupBy("a", "b").agg(
        F.sum(F.when(is_docs, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links")
    )
    highest = F.max("n_docs").over(Window.partitionBy("a"))  # at most as many rows as B has ids
    return sums.withColumn("is_best", F.col("n_docs") == highest)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by container, postings before documents: what the postings bring, per document."""
    now, total, best = None, np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
    for batch in batches:
        containers = batch.column("container").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(containers)) + 1).tolist(), len(containers)] if len(containers) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if containers[lo] != now:
                now = containers[lo]
                total[:] = best[:] = 0
            part = batch.slice(lo, hi - lo)
            n_postings = hi - lo - part.column("plane").null_count
            if n_postings:
                _add(part.slice(0, n_postings), total, best)
            if n_postings < hi - lo:
                own = part.slice(n_postings)
                slots = own.column("slot").to_numpy()
                extra = {"n_best": pa.array(best[slots]), "count_sum": pa.array(total[slots])}
                names = [f.split()[0] for f in SCORED.split(", ")]
                yield pa.RecordBatch.from_arrays([extra[n] if n in extra else own.column(n) for n in names], names=names)


def _add(part: pa.RecordBatch, total: np.ndarray, best: np.ndarray) -> None:
    bits = part.column("bits")
    offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
    weight = np.left_shift(1, np.maximum(part.column("plane").to_numpy(), 0).astype(np.int64))
    worth = weight * part.column("n_docs").to_numpy()
    is_best = part.column("is_best").to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for k in np.flatnonzero(length >= BITSET):
        slots = slots_of(bits[int(k)].as_py())
        total[slots] += worth[k]
        best[slots] += weight[k] * is_best[k]
    raw = np.frombuffer(bits.buffers()[2], "<u2")[offsets[0] // 2 : offsets[-1] // 2]
    few = np.repeat(length < BITSET, length // 2)
    slots = raw[few]
    sizes = np.where(length < BITSET, length // 2, 0)
    np.add.at(total, slots, np.repeat(worth, sizes))
    np.add.at(best, slots, np.repeat(weight * is_best, sizes))


def alignment_digest(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", held_entries: int = HELD_ENTRIES
) -> DataFrame:
    """Per row: tokens, groups and links, and what the links' pairs count in the whole corpus.

    Null and empty texts, and texts that one of the tokenizers cannot give back, have no tokens:
    zeros and an empty ``groups_sha256``. Every row is a document of its own, also a repeated one or
    one without id; ties for the highest count all count. An empty table gives an empty table. A
    very long text is worked on whole and alone. Other columns are not read.
    """
    index = index_documents(docs, a_path, b_path, id_col, text_col, held_entries)
    postings = index.where(F.col("a").isNotNull()).select("a", "b", "container", "plane", "bits", "n")
    counts = materialize(pair_counts(postings).drop("n_links"), "pair-counts")
    scored = postings.drop("n").join(counts.hint("merge"), ["a", "b"])  # grows with the corpus: never broadcast
    nothing = F.lit(None)
    up = scored.select(
        "container", "plane", "bits", "n_docs", "is_best", nothing.cast("int").alias("slot"),
        *(nothing.cast(t).alias(c) for c, t in _OWN),
    )
    down = index.where(F.col("a").isNull()).select(
        "container", "plane", "bits", nothing.cast("long").alias("n_docs"), nothing.cast("boolean").alias("is_best"), "slot",
        *(F.col(c) for c, _ in _OWN),
    )
    rows = up.unionByName(down).repartition("container").sortWithinPartitions("container", F.col("plane").asc_nulls_last())
    return rows.mapInArrow(_scored, SCORED)


_OWN = [("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")]

"""Benchmark decontamination: SimHash fingerprints of item-sized windows, then an exact check.

An item's fingerprint and those of windows with as many words are compared through a multi-index:
64 bits in eight blocks, so two fingerprints within ``RADIUS`` agree in some block up to
``RADIUS // 8`` bits, and a table of each block's neighbours finds all of them. Candidates are
verified by the weighted similarity of their five-word shingles (sum of minimal over sum of
maximal counts). Windows without any shingle of an item of their size have similarity 0 and get
no fingerprint; all others are looked at, at every position.

The items are a stated query set: they are taken in blocks of bounded bytes, each of which meets
all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bound_batches, pick
from clickloom.llm.words import WIDTH, hashed_words, shingles

BITS = 64
BLOCKS = 8
#: Two sets of similarity 0.75 differ in about 11 of 64 bits, with a deviation of 3.
RADIUS = 23
PERCENT = 75
INDEX_BYTES = 8 << 20  # item texts in one pass
FOUND = "doc_id long, item_id long, first_word long, n_window_words long, bits_apart int, similarity double"

_POPULATION = np.array([bin(v).count("1") for v in range(256)], np.uint8)
_CLOSE = np.array(
    [0, *(sum(1 << b for b in bits) for n in range(1, RADIUS // BLOCKS + 1) for bits in combinations(range(8), n))],
    np.uint8,
)  # what a block may be off by


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each shingle hash, +1 or -1 per bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """The bits with a positive sum, packed into eight bytes per row."""
    return np.packbits(sums > 0, axis=1)


def counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def weighted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of minimal and of maximal weights of two weighted sets."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    low = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return low, int(a[1].sum() + b[1].sum()) - low


class ItemIndex:
    """The items of one pass: fingerprints under a multi-index per window size, and weights."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words, self.sets, self.prints = [], [], [], []
        for item, words in zip(ids, hashed_words(texts), strict=True):
            own = shingles(words)
            if len(own):
                self.ids.append(item)
                self.words.append(len(words))
                self.sets.append(counts(own))
                self.prints.append(fingerprints(votes(own).sum(axis=0, dtype=np.int64)[None])[0])
        pairs = [(int(h), k) for k, (hashes, _) in enumerate(self.sets) for h in hashes]
        pairs.sort()
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.owner = np.array([k for _, k in pairs], np.int64)
        self.sizes = np.array(self.words, np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list[dict[int, np.ndarray]]]] = {}
        for size in set(self.words):
            items = np.flatnonzero(self.sizes == size)
            prints = np.stack([self.prints[k] for k in items])
            tables: list[dict[int, np.ndarray]] = []
            for block in range(BLOCKS):
                near: dict[int, list[int]] = {}
                for row, value in enumerate(prints[:, block]):
                    for off in _CLOSE:
                        near.setdefault(int(value ^ off), []).append(row)
                tables.append({v: np.array(rows) for v, rows in near.items()})
            self.by_size[size] = (items, prints, tables)

    def candidates(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per item of the size: rows of ``prints`` within the radius, and their distances."""
        items, own, tables = self.by_size[size]
        met = np.zeros((len(items), len(prints)), bool)
        for block, table in enumerate(tables):
            values, where = np.unique(prints[:, block], return_inverse=True)
            for v, value in enumerate(values):
                rows = table.get(int(value))
                if rows is not None:
                    met[np.ix_(rows, np.flatnonzero(where == v))] = True
        for k, item in enumerate(items):
            at = np.flatnonzero(met[k])
            if len(at):
                apart = _POPULATION[prints[at] ^ own[k]].sum(axis=1, dtype=np.int32)
                close = apart <= RADIUS
                if close.any():
                    yield int(item), at[close], apart[close]

    def search(self, words: np.ndarray, percent: int) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, bits apart, similarity) of each item's best window, if any."""
        own = shingles(words)
        if not len(own) or not len(self.hashes):
            return []
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        anchors = np.flatnonzero(self.hashes[at] == own)
        if not len(anchors):
            return []
        met: dict[int, list[np.ndarray]] = {}
        ends = np.searchsorted(self.hashes, own[anchors], side="right")
        for anchor, lo, hi in zip(anchors, at[anchors], ends, strict=True):
            for size in set(self.sizes[self.owner[lo:hi]].tolist()):
                met.setdefault(size, []).append(anchor)
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, found in met.items():
            span = max(1, size - WIDTH + 1)  # shingles of a window
            span = min(span, len(own))
            if (size < WIDTH or len(words) < WIDTH) and size != len(words):
                # the only shingle of a short item is the item itself: no longer text has it
                continue
            starts = np.zeros(len(own) + 1, np.int64)
            for anchor in found:
                starts[max(0, anchor - span + 1)] += 1
                starts[min(anchor, len(own) - span) + 1] -= 1
            starts = np.flatnonzero(np.cumsum(starts) > 0)
            starts = starts[starts <= len(own) - span]
            for part in np.array_split(starts, max(1, ceil(len(starts) / 2048))):
                self._windows(own, part, span, size, percent, best)
        return [
            (self.ids[k], first, min(size, len(words)), apart, round(score, 6))
            for k, (score, first, size, apart) in best.items()
        ]

    def _windows(self, own, starts, span, size, percent, best) -> None:
        low, high = int(starts[0]), int(starts[-1]) + span
        running = np.zeros((high - low + 1, BITS), np.int32)
        np.cumsum(votes(own[low:high]), axis=0, dtype=np.int32, out=running[1:])
        prints = fingerprints(running[starts - low + span] - running[starts - low])
        for item, rows, apart in self.candidates(size, prints):
            for row, bits in zip(rows, apart, strict=True):
                first = int(starts[row])
                small, large = weighted(counts(own[first : first + span]), self.sets[item])
                if 100 * small >= percent * large:
                    score = small / large
                    if item not in best or (score, -first) > (best[item][0], -best[item][1]):
                        best[item] = (score, first, size, int(bits))


def _searcher(index, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, words in zip(ids, hashed_words(batch.column("text").to_pylist()), strict=True):
                rows += [(doc, *found) for found in items.search(words, percent)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=[f.split()[0] for f in FOUND.split(", ")],
                )

    return run


def _item_blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items, at most about INDEX_BYTES of text at a time on the driver."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / INDEX_BYTES))
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "text").collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def contaminations(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """One row per document and benchmark item found in it, for the item's best window:
    doc_id, item_id, first_word, n_window_words, bits_apart, similarity.

    A window has as many words as the item (or is the whole text, if that is shorter). Null or
    blank texts and items meet nothing; an item of under five words is met only by a text that
    consists of it. Repeated documents or items give repeated rows, null ids stay null; empty
    tables give an empty result. Of equally similar windows the first counts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = pick(docs, doc_id=id_col, text=text_col)
    questions = pick(items, item_id=item_id, text=item_text).where("text is not null")
    found = None
    for ids, item_texts in _item_blocks(questions):
        index = spark.sparkContext.broadcast(ItemIndex(ids, item_texts))
        part = texts.mapInArrow(_searcher(index, percent), FOUND)
        found = part if found is None else found.union(part)
    return found


def _flagger(index, text_col: str, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            clean = [not items.search(words, percent) for words in hashed_words(texts)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns, in one pass
    per block of items and without a shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    questions = pick(items, item_id=item_id, text=item_text).where("text is not null")
    for ids, item_texts in _item_blocks(questions):
        index = spark.sparkContext.broadcast(ItemIndex(ids, item_texts))
        docs = docs.mapInArrow(_flagger(index, text_col, percent), docs.schema)
    return docs

"""Periodic runs of words: maximal stretches that repeat a short phrase four times or more.

The words of a text enter a suffix automaton one by one. Its suffix links form a tree whose nodes
carry the position at which they last ended; the new prefix recolours its path to the root. A
link-cut tree keeps that path as segments of one colour, so a step touches few of them. A segment
with colour p and longest suffix l says that the l words before this position also ended at p: if
the distance d to p is at most l, the last 2d words are a square of period d. The square reaches
back l + d words, and is extended forward to the whole run. At the first square of a run its colour
is exactly one period back, so no run is missed and the distance is its smallest period.

Only stretches in which runs may lie enter the automaton. Every five words of a run (length at least
six and four periods) recur inside it at a distance of at most a quarter of the stretch that holds
it; positions for which that fails are taken out, which shortens stretches, until none fails. This
is a property of runs, so nothing is lost, and texts without periodic stretches cost one pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bound_batches
from clickloom.llm.words import hash_spans_exact, mix, slices, stream, word_spans

SHORTEST = 6  # words of the shortest run
PERIODS = 4  # periods of the shortest run
GRAM = 5
_PLACE = stream(11, GRAM) | np.uint64(1)
OUT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
       "collapsed_sha256 string")
RUNS = "doc_id long, start long, length long, period long"


class Automaton:
    """Suffix automaton of a growing word sequence, its link tree kept as coloured path segments.

    ``append`` returns what the new prefix meets on its way to the root: pairs of an earlier end
    and the length of the longest suffix that ended there, longest first.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        # splay trees over path segments: parent (a path parent if not its child), children, colour at roots
        self.parent, self.left, self.right, self.colour = [-1], [-1], [-1], [-1]
        self.last, self.position = 0, -1

    def _node(self, edges: dict, link: int, length: int, colour: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.parent.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.colour.append(colour)
        return len(self.link) - 1

    def append(self, word) -> list[tuple[int, int]]:
        nexts, link, length = self.next, self.link, self.length
        self.position += 1
        p, last = self.last, self.last
        origin = 0
        while p != -1 and word not in nexts[p]:
            p = link[p]
        if p != -1:
            q = nexts[p][word]
            origin = q if length[q] == length[p] + 1 else self._split(p, q, word)
        new = self._node({}, origin, length[last] + 1, -1)
        p = last
        while p != -1 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        self.last = new
        return self._access(new)

    def _split(self, p: int, q: int, word) -> int:
        """A copy of q for the shorter strings that end at p's edge; it stands above q with q's colour."""
        nexts, link, left, parent = self.next, self.link, self.left, self.parent
        self._splay(q)
        clone = self._node(dict(nexts[q]), link[q], self.length[p] + 1, self.colour[q])
        above = left[q]
        if above != -1:
            left[q] = -1
            parent[above] = parent[q]
            self.colour[above] = self.colour[q]
        else:
            parent[clone] = parent[q]
        parent[q] = link[q] = clone
        while p != -1 and nexts[p].get(word) == q:
            nexts[p][word] = clone
            p = link[p]
        return clone

    def _splay(self, x: int) -> None:
        """Make x the root of its segment's tree; trees are ordered by depth, deeper to the right."""
        parent, left, right = self.parent, self.left, self.right
        y = parent[x]
        while y != -1 and (left[y] == x or right[y] == x):
            z = parent[y]
            z_holds = z != -1 and (left[z] == y or right[z] == y)
            if not z_holds:
                self.colour[x] = self.colour[y]
                self._up(x, y)
            elif (left[z] == y) == (left[y] == x):
                g = parent[z]
                if g == -1 or (left[g] != z and right[g] != z):
                    self.colour[x] = self.colour[z]
                self._up(y, z)
                self._up(x, y)
            else:
                g = parent[z]
                if g == -1 or (left[g] != z and right[g] != z):
                    self.colour[x] = self.colour[z]
                self._up(x, y)
                self._up(x, z)
            y = parent[x]

    def _up(self, x: int, y: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        z = parent[y]
        if left[y] == x:
            inner = right[x]
            left[y], right[x] = inner, y
        else:
            inner = left[x]
            right[y], left[x] = inner, y
        if inner != -1:
            parent[inner] = y
        parent[y], parent[x] = x, z
        if z != -1:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _access(self, x: int) -> list[tuple[int, int]]:
        """Join the path from x to the root into one segment with the current position as colour."""
        parent, right, colour = self.parent, self.right, self.colour
        met, below = [], -1
        while x != -1:
            self._splay(x)
            if below != -1 and self.length[x]:
                met.append((colour[x], self.length[x]))
            rest = right[x]
            if rest != -1:
                colour[rest] = colour[x]
            right[x] = below
            below = x
            x = parent[x]
        colour[below] = self.position
        return met


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word sequence, by start and period."""
    automaton, n = Automaton(), len(words)
    until: dict[int, int] = {}  # where the last run of a period ends
    found = []
    for i, word in enumerate(words):
        before = -1
        for p, suffix in automaton.append(word):
            d = i - p
            if p == before or d > suffix or until.get(d, -1) >= i:
                continue
            before = p
            end = i + 1
            while end < n and words[end] == words[end - d]:
                end += 1
            until[d] = end - 1
            start = i - d - suffix + 1
            if end - start >= max(SHORTEST, PERIODS * d):
                found.append((start, end - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Where runs may lie: first word and end of the stretches, from the words' hashes."""
    n = len(words) - GRAM + 1
    if n < 2:
        return []
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams += words[k : k + n] * _PLACE[k]
    at = np.arange(n)
    grams = mix(grams)
    while len(at) > 1:
        opens = np.diff(at, prepend=-2) > 1
        group = np.cumsum(opens)
        size = np.bincount(group)[group] + GRAM - 1
        order = np.lexsort((at, grams, group))
        same = (grams[order][1:] == grams[order][:-1]) & (group[order][1:] == group[order][:-1])
        gap = np.where(same, np.diff(at[order]), len(words))
        near = np.full(len(at), len(words))
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        keep = (near * PERIODS <= size) & (size >= SHORTEST)
        if keep.all():
            break
        at, grams = at[keep], grams[keep]
    if len(at) < 2:
        return []
    edge = np.flatnonzero(np.diff(at) > 1)
    firsts, lasts = at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)]
    return [(int(a), int(b) + GRAM) for a, b in zip(firsts, lasts, strict=True) if b + GRAM - a >= SHORTEST]


def text_runs(words: list[bytes], hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of a whole text, found in its stretches."""
    found = []
    for first, end in stretches(hashes):
        found += [(first + s, length, q) for s, length, q in runs_of(words[first:end])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten: the word numbers of its altered form, periodic from some word on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


def _documents(batch: pa.RecordBatch, alter: bool) -> Iterator[tuple[int | None, list[bytes], np.ndarray]]:
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for first, last, data, offsets in slices(texts):
        starts, ends = word_spans(data)
        hashes = hash_spans_exact(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        raw = data.tobytes()
        for k in range(last - first):
            words = raw[offsets[k] : offsets[k + 1]].split()
            own = hashes[bounds[k] : bounds[k + 1]]
            places = planted(ids[first + k], len(words)) if alter else None
            if places is not None:
                words, own = [words[i] for i in places.tolist()], own[places]
            yield ids[first + k], words, own


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def _table(rows: list[tuple], names: list[str], texts: int) -> pa.RecordBatch:
    types = [pa.int64()] * (len(names) - texts) + [pa.string()] * texts
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every run of every text: ``doc_id``, first word, length and period in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *r) for doc, words, hashes in _documents(batch, False) for r in text_runs(words, hashes)]
            if rows:
                yield _table(rows, ["doc_id", "start", "length", "period"], 0)

    return _own(docs, id_col, text_col).mapInArrow(run, RUNS)


def collapsed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with one period left of each run, its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, b" ".join(without_repeats(words, text_runs(words, hashes))).decode())
                    for doc, words, hashes in _documents(batch, False)]
            if rows:
                yield _table(rows, ["doc_id", "text"], 1)

    return _own(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: bool = True) -> DataFrame:
    """Per row: its runs counted, the longest one, and hashes of all runs and of the collapsed text.

    ``alter`` makes one document in ten periodic from some word on (``planted``) before the search.
    Null and empty texts have no words: no runs, four nulls, hashes of nothing. Among longest runs
    the smallest start, then the smallest period wins. Repeated rows and null ids stay rows (a null
    id is never altered), an empty table gives an empty one, and other columns are not read. A very
    long text is worked on alone; only its periodic stretches enter an automaton.
    """

    def row(doc: int | None, words: list[bytes], hashes: np.ndarray) -> tuple:
        runs = text_runs(words, hashes)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        return (doc, len(runs), start, length, period, 1000 * length // period if runs else None,
                hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(b" ".join(without_repeats(words, runs))).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*d) for d in _documents(batch, alter)]
            if rows:
                yield _table(rows, [f.split()[0] for f in OUT.split(", ")], 2)

    return _own(docs, id_col, text_col).mapInArrow(run, OUT)

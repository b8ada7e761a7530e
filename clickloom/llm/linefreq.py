"""Quality rules: word statistics and cross-document line frequency per host.

Lines are normalised (words in lower case, one space between) and hashed. A line that more than a
share of a host's documents contain is boilerplate and is removed; a document of which too little
remains is rejected. Documents of a host with the same set of lines count as one, so that the lines
of a text that has many copies do not look like boilerplate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clickloom.llm.common import bound_batches, materialize, split_join
from clickloom.llm.words import hash_spans_exact, slices, stream, word_spans

LINE_SHARE = 0.03  # of a host's documents
LINE_DOCS = 10  # and more documents than this
LEAST_WORDS = 20
LEAST_SHARE = 0.2  # of a document's words must remain
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = stream(21, WINDOW) | np.uint64(1)

STATS = (
    "doc_id long, host string, row_a long, row_b long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, set_a long, set_b long, lines array<struct<line:long,words:long>>"
)


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in an 8-word window found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows += words[k : n + k] * _PLACE[k]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    change = np.zeros(len(words) + 1, np.int64)
    change[starts] += 1
    change[starts + WINDOW] -= 1
    return int((np.cumsum(change) > 0).sum())


def line_hash(words: list[bytes]) -> int:
    """The first eight bytes of the MD5 of a normalised line, as a signed number in their order."""
    return int.from_bytes(hashlib.md5(b" ".join(words)).digest()[:8], "big") - (1 << 63)


def line_words(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and the words of each distinct normalised line."""
    seen, twice, found = set(), 0, {}
    for line in text.split(b"\n"):
        words = line.lower().split()
        if words:
            twice += line in seen
            seen.add(line)
            key = line_hash(words)
            found[key] = found.get(key, 0) + len(words)
    return twice, found


def set_hash(lines: Iterable[int]) -> tuple[int, int]:
    """Two 64-bit hashes that stand for a document's set of lines."""
    digest = hashlib.md5(np.array(sorted(lines), "<i8").tobytes()).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n_words, chars, symbols, dups, repeats, lines, sets = [], [], [], [], [], [], []
        for first, last, data, offsets in slices(texts):
            starts, ends = word_spans(data)
            words = hash_spans_exact(data, starts, ends)
            bounds = np.searchsorted(starts, offsets)
            lead = ~_SPACE[data] & ((data & 0xC0) != 0x80)
            char_sum = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])[offsets]
            symbol_sum = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])[offsets]
            chars += np.diff(char_sum).tolist()
            symbols += np.diff(symbol_sum).tolist()
            n_words += np.diff(bounds).tolist()
            raw = data.tobytes()
            for i in range(last - first):
                repeats.append(repeated_words(words[bounds[i] : bounds[i + 1]]))
                twice, own = line_words(raw[offsets[i] : offsets[i + 1] - 1])
                dups.append(twice)
                sets.append(set_hash(own))
                lines.append([{"line": k, "words": v} for k, v in own.items()])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("host").cast(pa.string()),
                batch.column("row_a"),
                batch.column("row_b"),
                *(pa.array(x, pa.int64()) for x in (n_words, chars, symbols, dups, repeats)),
                *(pa.array([m[k] for m in sets], pa.int64()) for k in (0, 1)),
                pa.array(lines, kind),
            ],
            names=[f.split()[0] for f in STATS.split(", ")],
        )


def _named(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> list:
    """Columns of the statistics pass; two hashes of the row stand for it in later joins."""
    own = [F.col(f"`{c}`") for c in (id_col, host_col, text_col)]
    return [
        own[0].alias("doc_id"),
        F.coalesce(own[1].cast("string"), F.lit("")).alias("host"),
        own[2].alias("text"),
        F.xxhash64(*own, *(c.isNull() for c in own)).alias("row_a"),
        F.xxhash64(F.lit(7), *own[::-1], *(c.isNull() for c in own)).alias("row_b"),
    ]


def _judge(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """Statistics with verdicts per row, and the boilerplate lines of each row that has any."""
    bound_batches(docs.sparkSession)
    stats = materialize(docs.select(*_named(docs, id_col, text_col, host_col)).mapInArrow(_stats, STATS), "line-stats")
    lines = stats.select("row_a", "row_b", "host", "set_a", "set_b", F.explode("lines").alias("l"))
    lines = lines.select("row_a", "row_b", "host", "set_a", "set_b", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    unlike = stats.select("host", "set_a", "set_b").distinct()  # one for each document and its copies
    hosts = materialize(unlike.groupBy("host").agg(F.count(F.lit(1)).alias("docs")), "hosts")
    counted = (
        lines.select("host", "line", "set_a", "set_b").distinct()
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > LINE_DOCS)
        .join(hosts, "host")
        .where(F.col("n") > LINE_SHARE * F.col("docs"))
        .select("host", "line")
    )
    common = split_join(lines.drop("set_a", "set_b"), counted, ["host", "line"], "inner", "common-lines")
    removed = materialize(
        common.distinct().groupBy("row_a", "row_b").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("common")),
        "removed-lines",
    )
    rest = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.coalesce("lost", F.lit(0)) > 0
    depleted &= (rest < LEAST_WORDS) | (rest < LEAST_SHARE * F.col("n_words"))
    narrow = stats.drop("lines", "set_a", "set_b")
    judged = narrow.join(removed.drop("common"), ["row_a", "row_b"], "left").select(
        *narrow.columns, rest.alias("rest_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept")
    )
    return judged, removed


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rest_words (words outside the removed lines).

    A null text counts as empty and fails; a null host is the host ''. Documents of a host with the
    same set of lines count once in line frequencies, as lines and as documents, and give a row
    each; near copies count each. An empty table gives an empty result.
    """
    judged, _ = _judge(docs, id_col, text_col, host_col)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rest_words"
    )


def _without(text: str, common: list[int]) -> str:
    gone, lines = set(common), []
    for line in text.split("\n"):
        words = line.encode().lower().split()
        if not words or line_hash(words) not in gone:
            lines.append(line)
    return "\n".join(lines)


@F.pandas_udf(StringType())
def _trimmed(text: pd.Series, common: pd.Series) -> pd.Series:
    pairs = zip(text, common, strict=True)
    return pd.Series([t if t is None or c is None else _without(t, list(c)) for t, c in pairs], dtype=object)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, without their boilerplate lines; all columns stay.

    A column ``n_chars`` is set to the new length where lines were removed.
    """
    judged, removed = _judge(docs, id_col, text_col, host_col)
    edits = materialize(
        judged.join(removed.select("row_a", "row_b", "common"), ["row_a", "row_b"], "left")
        .where("not kept or common is not null")
        .select("row_a", "row_b", "kept", "common")
        .dropDuplicates(["row_a", "row_b"]),
        "line-edits",
    )
    named = _named(docs, id_col, text_col, host_col)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *named[3:])
    joined = packed.join(edits, ["row_a", "row_b"], "left").where("kept is null or kept")
    text = F.col(f"doc.`{text_col}`")
    new = F.when(F.col("common").isNotNull(), _trimmed(text, "common")).otherwise(text)
    length = F.when(F.col("common").isNotNull(), F.length("new").cast("long"))
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {text_col: F.col("new")}
    if "n_chars" in out:
        out["n_chars"] = length.otherwise(out["n_chars"])
    return joined.withColumn("new", new).select(*(v.alias(c) for c, v in out.items()))

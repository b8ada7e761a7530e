"""Language of documents by multilingual mixture inference.

A text is a mixture of languages: each of its byte trigrams comes from language l with probability
p(l), and then from l's trigram distribution, learned by counting all training texts. Expectation
maximisation estimates p for a set of languages. The set grows one language at a time, each time
by the one that raises the likelihood most, as long as the gain exceeds the penalty (half the
logarithm of the number of trigrams per language, as the Bayesian information criterion has it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bound_batches, pick
from clickloom.llm.words import mix

BUCKETS = 1 << 15  # trigrams are hashed; the model has this many numbers per language
SMOOTHING = 0.5
ROUNDS = 30
SETTLED = 1e-4
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 32  # digits and ASCII marks say nothing about a language
_FOLD[[b for b in range(33, 128) if not chr(b).isalnum()]] = 32
_GRAM = (mix(np.arange(1 << 24, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.uint16)


def grams(text: bytes) -> np.ndarray:
    """Hashed trigrams of the folded bytes; those of blanks alone are left out."""
    raw = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint16)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return _GRAM[code[(raw[1:-1] != 32) | ((raw[:-2] != 32) & (raw[2:] != 32))]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed counts of one task: one row per language and bucket met."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = grams(text.encode("utf-8", "surrogatepass"))
            if lang not in held:
                held[lang] = np.zeros(BUCKETS, np.int64)
            held[lang] += np.bincount(found, minlength=BUCKETS)
    for lang, own in held.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])],
            names=["lang", "bucket", "n"],
        )


class Model:
    """Trigram distributions of the learned languages, and inference on one text."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(axis=1, keepdims=True) if len(langs) else counts

    def fit(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the rows of ``p`` and the log-likelihood of counts ``n``."""
        share = np.full(len(p), 1 / len(p))
        total = n.sum()
        if len(p) > 1:
            for _ in range(ROUNDS):
                joint = share[:, None] * p
                new = (joint / joint.sum(axis=0) * n).sum(axis=1) / total
                moved, share = np.abs(new - share).max(), new
                if moved < SETTLED:
                    break
        return share, float((n * np.log(share @ p)).sum())

    def mixture(self, text: bytes) -> dict[str, float]:
        """The chosen languages and their proportions; empty if the text has no trigram."""
        found = grams(text)
        if not len(found) or not self.langs:
            return {}
        buckets, n = np.unique(found, return_counts=True)
        p = self.p[:, buckets]
        penalty = 0.5 * np.log(n.sum())
        single = (n * np.log(p)).sum(axis=1)
        chosen = [int(single.argmax())]
        share, best = np.ones(1), float(single.max())
        while len(chosen) < len(self.langs):
            options = []
            for lang in set(range(len(self.langs))) - set(chosen):
                own, value = self.fit(p[[*chosen, lang]], n)
                options.append((value, -lang, own))
            value, lang, own = max(options, key=lambda o: o[:2])
            if value - best <= penalty:
                break
            chosen, share, best = [*chosen, -lang], own, value
        return {self.langs[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def learn(training: DataFrame) -> Model:
    """Count the trigrams of all training texts (text, lang); null texts and languages are left out.

    The model has ``BUCKETS`` numbers per language: its size depends on the languages alone.
    """
    rows = training.where("text is not null and lang is not null")
    table = (
        rows.mapInArrow(_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    row = np.searchsorted(np.array(langs), np.array(table.column("lang").to_pylist())) if langs else []
    counts[row, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, counts)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, mixes = [], [], []
            for text in batch.column("text").to_pylist():
                found = {}
                if text is not None and _LETTER.search(text):
                    found = model.value.mixture(text.encode("utf-8", "surrogatepass"))
                top = max(found, key=lambda k: (found[k], k), default=None)
                names.append(top or UNKNOWN)
                scores.append(min(1.0, found[top]) if top else 0.0)
                mixes.append(sorted(found.items()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "proportions"],
            )

    return run


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (its share), proportions.

    Learns from the documents whose crc32 of the id, as text, is no multiple of 5; only a text's
    bytes decide its prediction. A null text, one without a letter, or any text when nothing was
    learned is ``und`` with score 0; so is a text whose letters form no trigram. A null id counts
    as held out. Repeated rows are rows of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    own = own.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), (F.coalesce(fold, F.lit(0)) == 0).alias("held_out"))
    model = spark.sparkContext.broadcast(learn(own.where("not held_out").select("text", "lang")))
    return own.select("doc_id", "text", "held_out").mapInArrow(
        _predict(model),
        f"doc_id {docs.select(F.col(f'`{id_col}`')).dtypes[0][1]}, held_out boolean, lang_pred string, "
        "score double, proportions map<string,double>",
    )

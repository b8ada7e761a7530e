"""Token alignment and its pair bitmaps against a plain version over whole texts."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clickloom.llm import alignment
from clickloom.llm.catalog import op12_pair_bitmaps
from clickloom.llm.streambpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """rows: (doc_id, text) -> sorted result rows, from whole texts and occurrence pairs."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    with open(A, encoding="utf-8") as file:
        a_bytes = {n: bytes(letters[c] for c in w) for w, n in json.load(file)["model"]["vocab"].items() if set(w) <= letters.keys()}

    def piece(n):
        text = sp.id_to_piece(n)
        return bytes([int(text[3:5], 16)]) if sp.is_byte(n) else text.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(map(piece, b)) != raw:
            docs.append((doc_id, [], [], []))
            continue
        groups, x, y, i, j, p, q = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if p <= q and i < len(a):
                x.append(a[i])
                p += len(a_bytes[a[i]])
                i += 1
            else:
                y.append(b[j])
                q += len(piece(b[j]))
                j += 1
            if p == q:
                groups.append((x, y))
                x, y = [], []
        docs.append((doc_id, a, b, groups))
    links = [[(u, v) for x, y in groups for u in x for v in y] for *_, groups in docs]
    count = Counter(pair for own in links for pair in set(own))
    best = Counter()
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    out = []
    for (doc_id, a, b, groups), own in zip(docs, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(own), sum(count[p] == best[p[0]] for p in own),
                    sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(op12_pair_bitmaps(spark, folder)) == plain(rows)


PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "中文", "\U0001f600", "▁", "<s>", "<|endoftext|>", "<0x0A>", "don't",
         "naïve,", " ", "　", "\x85", "12345", "...", "\x1c", "ﬁ", "é", "=====", "supercalifragilistic"]


@pytest.mark.parametrize("seed", range(2))
def test_odd_texts(spark, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    texts += [None, "", " ", "  ", "a ", " a", "x" * 5000, "一丁" * 900, "the cat " * 9000]
    rows = [(rnd.choice([None, *range(50)]), text) for text in texts]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, container string, n_a int").repartition(3)
    assert got(alignment.alignment_digest(docs, A, B)) == plain(rows)
    assert got(alignment.alignment_digest(docs.limit(0), A, B)) == []


def test_bitmaps_of_all_sizes():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, alignment.CONTAINER, n)) for n in (1, 3, 4000, 4200, 60_000)]
    packed = alignment.compressed(np.concatenate(sets), np.cumsum([len(s) for s in sets])).to_pylist()
    for own, bits in zip(sets, packed, strict=True):
        assert np.array_equal(alignment.slots_of(bits), own) and len(bits) <= alignment.BITSET
    both = alignment.merged_bits(packed)
    assert np.array_equal(alignment.slots_of(both), np.unique(np.concatenate(sets)))


def test_parts_merge_and_counts(spark):
    """Parts of a container meet again, whatever batch they come in."""
    one = [alignment.compressed(np.array(s), np.array([len(s)]))[0].as_py() for s in ([1, 5], [2], [9], list(range(0, 60_000, 3)))]
    rows = [(7, 1, 10, -1, one[0]), (7, 1, 10, -1, one[1]), (7, 1, 10, 0, one[2]), (7, 1, 11, -1, one[3]), (7, 1, 11, -1, one[0]),
            (7, 2, 10, -1, one[2]), (8, 2, 10, -1, one[1])]
    index = spark.createDataFrame(rows, "a int, b int, container long, plane int, bits binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        postings = alignment.postings_of(index)
        n = {(r.a, r.b, r.container, r.plane): r.n for r in postings.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert n == {(7, 1, 10, -1): 3, (7, 1, 10, 0): 1, (7, 1, 11, -1): 20_002, (7, 2, 10, -1): 1, (8, 2, 10, -1): 1}
    counts = {(r.a, r.b): (r.n_docs, r.n_links, r.is_best) for r in alignment.pair_counts(postings).collect()}
    assert counts == {(7, 1): (20_005, 20_006, True), (7, 2): (1, 1, False), (8, 2): (1, 1, True)}


def test_tasks_that_hold_little(spark):
    """Bitmaps leave often: the same result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(alignment.alignment_digest(docs, A, B, held_entries=500)) == plain(rows)

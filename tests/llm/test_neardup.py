"""Near-duplicates against all pairs, on the shared documents, planted groups and odd rows."""

import random
from pathlib import Path

import brute
import numpy as np
import pytest

from clickloom.llm import neardup
from clickloom.llm.components import connected
from clickloom.llm.words import hashed_words, shingles
from clickloom.session import work_dir

SCHEMA = "doc_id long, text string, component_id string"


def run(docs):
    return {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}


@pytest.fixture(scope="module")
def planted():
    """A star of near copies around one text, whose leaves are mostly unlike each other."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    rows = [(1000, " ".join(base), None)]
    for k in range(60):
        copy = list(base)
        for _ in range(3 + k % 6):
            copy[draw.randrange(200)] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(copy), "clash"))
    shared = " ".join(base[:60])
    for k in range(60):
        rows.append((200 + k, shared + " " + " ".join(f"y{draw.randrange(10**6)}" for _ in range(90)), None))
    rows += [(300 + k, " ".join(base).upper(), "copy") for k in range(20)]
    return rows


def test_shared_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.components([(r.doc_id, r.text) for r in docs.collect()])
    got = {i: c for (i, _), (c, _) in run(docs).items()}
    assert got == want


def test_planted_groups(spark, planted, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_BYTES", 20_000)  # several blocks of sets
    want = brute.components([(i, t) for i, t, _ in planted])
    got = run(spark.createDataFrame(planted, SCHEMA))
    assert {i: c for (i, _), (c, _) in got.items()} == want
    assert all(kept == (i == c) for (i, _), (c, kept) in got.items())


def test_odd_rows(spark):
    long = " ".join(f"v{k % 977}" for k in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "one two", "a"), (5, "ONE  two", "a"),
        (6, "one three", "a"), (7, long, None), (8, long + " tail", None), (9, "a b c d e f", None),
        (9, "a b c d e f", None), (None, "one two", None), (10, "É b c d e f", None), (11, "é b c d e f", None),
    ]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found}
    assert {g for g in got if g[0] in (1, 2, 3)} == {(k, 0, k, True) for k in (1, 2, 3)}
    assert {(4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True)} <= got
    assert {(c, k) for i, _, c, k in got if i in (7, 8)} == {(7, True), (7, False)}
    assert {(9, 2, 9, True), (10, 2, 10, True), (11, 2, 11, True)} <= got
    kept = neardup.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 9, 10, 11, None]))


def test_rows_of_one_id_with_different_texts_stay(spark):
    one, other = "a b c d e f g", "quite other text of some seven words"
    rows = [(1, one, 0, "x"), (1, other, 0, "x"), (1, one, 0, "x"), (2, one, 0, "y"), (2, other + " more", 0, "y"), (3, one, 1, "z"),
            (None, one, 0, "n"), (None, one, 0, "n"), (4, None, 0, "v"), (4, None, 0, "v"), (5, "unlike all the rest of these", 0, "_id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, `row.a` string")
    got = sorted((tuple(r) for r in neardup.keep_one(docs).collect()), key=repr)
    assert got == sorted([rows[0], rows[1], rows[6], rows[7], rows[8], rows[10]], key=repr)
    assert neardup.keep_one(docs.limit(0)).collect() == []


def test_intermediates_are_deleted(spark):
    folder = Path(work_dir(spark))
    before = set(folder.iterdir())
    neardup.keep_one(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    left = {p.name.split("-", 1)[1].rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left.isdisjoint({"sketches", "members", "sets", "tiles", "hub-pairs", "links", "all-links", "copies", "buckets"})


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == {}


def test_words_follow_the_rule():
    texts = ["A bC\x0bd\x1ce f g", None, "", "ÄÖ Äö x" * 3, " lead", "trail\r\n"]
    names = {}
    for text, hashes in zip(texts, hashed_words(texts), strict=True):
        want = brute.words(text)
        assert len(want) == len(hashes)
        for w, h in zip(want, hashes, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert len(shingles(np.arange(7, dtype=np.uint64))) == 3


def test_looks_keep_pairs_at_the_threshold():
    draw = np.random.default_rng(3)
    left = draw.integers(0, 256, (4000, neardup.HASHES)).astype(np.uint8)
    same = draw.random(left.shape) < 0.75
    right = np.where(same, left, draw.integers(0, 256, left.shape)).astype(np.uint8)
    assert len(neardup.surviving(left, right, 75)) >= 3997
    far = np.where(draw.random(left.shape) < 0.5, left, draw.integers(0, 256, left.shape)).astype(np.uint8)
    assert len(neardup.surviving(left, far, 75)) == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}

"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import runs
from clickloom.llm.catalog import op11_periodic_runs
from clickloom.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every maximal stretch by trying each period; a multiple of a smaller period does not count."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(6, 4 * q):
                smaller = any(all(words[k] == words[k + d] for k in range(start, end - d)) for d in range(1, q))
                if not smaller:
                    found.append((start, end - start, q))
            start = end - q + 1
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def hashed(words):
    return mix(np.array([zlib.crc32(str(w).encode()) + 1 for w in words], np.uint64))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_small_alphabets(words):
    assert runs.runs_of(words) == plain_runs(words)
    assert runs.text_runs(words, hashed(words)) == plain_runs(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=7))
def test_repeated_phrases(parts):
    words = [w for phrase, times in parts for w in phrase * times]
    assert runs.runs_of(words) == plain_runs(words) == runs.text_runs(words, hashed(words))


@pytest.mark.parametrize("seed", range(6))
def test_long_texts(seed):
    rnd = random.Random(seed)
    words = [rnd.randint(0, 400) for _ in range(700)]
    for _ in range(6):
        at, q = rnd.randrange(len(words)), rnd.randint(1, 60)
        phrase = words[at : at + q]
        words[at:at] = phrase * rnd.randint(1, 6)
    assert runs.text_runs(words, hashed(words)) == plain_runs(words)


def test_automaton_meets_longest_suffixes():
    """Each pair is an earlier end and the length of the longest common suffix with it."""
    rnd = random.Random(3)
    words, automaton = [], runs.Automaton()
    for i in range(300):
        words.append(rnd.randint(0, 2))
        seen = set()
        for p, length in automaton.append(words[i]):
            if p not in seen:
                k = 0
                while k <= p and words[p - k] == words[i - k]:
                    k += 1
                assert p < i and k == length
            seen.add(p)


def test_stretches_leave_plain_text_out():
    words = hashed(range(5000))
    assert runs.stretches(words) == []
    twice = np.concatenate([words[:100], words[:100], words[200:300]])
    assert runs.stretches(twice) == []
    assert runs.stretches(np.concatenate([words[:50], *[words[50:57]] * 5, words[60:90]])) != []


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted(map(tuple, op11_periodic_runs(spark, folder).collect()))
    short = [r for r in rows if len(r.text or "") < 9000]
    assert len(got) == len(rows) and len(short) > 150
    want = {r.doc_id: expected(r.doc_id, r.text) for r in short}
    assert {r[0]: r for r in got if r[0] in want} == want
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    rows = [(i, "a b c " * 9 + "d") for i in (1, 1, None)] + [(7, None), (8, ""), (9, " \t\n"), (10, "x" * 300_000),
            (11, "é b\x0bé b\x0c" * 20 + "A a A a A a"), (12, "a b " * 6), (25, "w v " * 300)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    got = sorted(map(tuple, runs.run_digest(docs).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert runs.run_digest(docs.limit(0)).collect() == []
    plain = {(r.doc_id, r.start, r.length, r.period) for r in runs.periodic_runs(docs).where("doc_id = 11").collect()}
    assert plain == {(11, s, n, q) for s, n, q in plain_runs(WORD.findall(rows[7][1]))}
    assert runs.collapsed_texts(docs).where("doc_id = 12").first().text == "a b"


def test_most_periodic_text(spark):
    """Words of a Fibonacci string and of one letter: many squares, few runs of four periods."""
    a, b = "a", "ab"
    while len(b) < 2500:
        a, b = b, b + a
    assert runs.runs_of(list(b[:600])) == plain_runs(list(b[:600]))
    assert runs.runs_of(["w"] * 3000) == [(0, 3000, 1)]

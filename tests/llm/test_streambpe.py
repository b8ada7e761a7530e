"""Streaming byte-level BPE against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickloom.llm import streambpe
from clickloom.llm.catalog import op13_streaming_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OTHER = Tokenizer.from_file(PATH)
V = streambpe.vocabulary_of(PATH)


def want(text):
    return OTHER.encode(text, add_special_tokens=False).ids


def in_parts(text, sizes):
    encoder, out, at = streambpe.Encoder(V), [], 0
    for n in sizes:
        out.append(encoder.feed(text[at : at + n]))
        at += n
    out += [encoder.feed(text[at:]), encoder.finish()]
    return np.frombuffer(b"".join(out), "<u4").tolist()


PARTS = st.sampled_from(["a", "b", "e", " ", "  ", "\n", "\t", "'", "'s", "'re", "1", "é", "中", "͸", "꟎", "\U0001f600",
                         " ", "　", "!", "<|", "<|endoftext|>", "endoftext|>", " the", "tion", "\x1c", "\x85", "ǅ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40), st.lists(st.integers(1, 9), max_size=12))
def test_any_cut_gives_the_same_ids(parts, sizes):
    text = "".join(parts)
    assert in_parts(text, sizes) == want(text)


@pytest.mark.parametrize("seed", range(12))
def test_endless_pieces(seed):
    rnd = random.Random(seed)
    vocabulary = [t for t in OTHER.get_vocab() if t.isascii() and t.isalpha()]
    texts = [
        "".join(rnd.choice("abcdeinrst") for _ in range(6000)),
        "".join(rnd.choice(vocabulary) for _ in range(1500)),
        rnd.choice(" \n\t") * 5000 + rnd.choice(["", "x", " y", "1", "<|endoftext|>"]),
        " " + rnd.choice("=-_*a1") * 5000 + rnd.choice(["", " x", "x", "\n\n"]),
    ]
    for text in texts:
        assert in_parts(text, [rnd.randint(1, 900) for _ in range(8)]) == want(text)


def test_window_is_bounded():
    window, most = streambpe.Window(V), 0
    for _ in range(200):
        window.feed(b"aab" * 333)
        most = max(most, len(window.held))
    assert most <= 5 * V.ahead
    encoder = streambpe.Encoder(V)
    for _ in range(200):
        encoder.feed("ab" * 500)
        assert len(encoder.tail) + len(encoder.held) <= 2 * streambpe.OPEN_CHARS + 1000


def small_bpe(rnd):
    """A random proper merge list over a, b, c and its lookahead."""
    tokens, merges = [b"a", b"b", b"c"], []
    while len(merges) < 25:
        u, v = rnd.choice(tokens), rnd.choice(tokens)
        if u + v not in tokens and len(u + v) < 12:
            merges.append((u, v))
            tokens.append(u + v)
    return merges


def plain_bpe(merges, data):
    ids = [bytes([b]) for b in data]
    for u, v in merges:
        k, out = 0, []
        while k < len(ids):
            hit = k + 1 < len(ids) and ids[k] == u and ids[k + 1] == v
            out.append(u + v if hit else ids[k])
            k += 2 if hit else 1
        ids = out
    return ids


@pytest.mark.parametrize("seed", range(40))
def test_lookahead_suffices(seed):
    """Tokens that end a lookahead before the cut are the same for every continuation."""
    rnd = random.Random(seed)
    merges = small_bpe(rnd)
    ahead = streambpe.lookahead(merges)
    for _ in range(60):
        head = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 60)))
        settled, end = [], 0
        for token in plain_bpe(merges, head):
            end += len(token)
            if end > len(head) - ahead:
                break
            settled.append(token)
        for _ in range(6):
            more = head + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 20)))
            assert plain_bpe(merges, more)[: len(settled)] == settled


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=60), st.integers(1, 5))
def test_decoder(ids, step):
    decoder = streambpe.Decoder(V)
    text = "".join(decoder.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + decoder.finish()
    assert text == OTHER.decode(ids, skip_special_tokens=False)


def test_query_matches_library(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_streaming_bpe(spark, folder).collect()}
    assert len(got) == len(rows)
    for row in rows:
        ids = want(row.text or "")
        text = OTHER.decode(ids, skip_special_tokens=False)
        assert got[row.doc_id] == (
            row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        )


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", "z"), (3, "word " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(streambpe.coding_digest(docs, PATH).collect(), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in got if r.doc_id == 1] == [2, 2]
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (None, 2)} == {(0, empty, empty)}
    assert next(r.n_tokens for r in got if r.doc_id == 3) == len(want("word " * 60_000))
    assert streambpe.coding_digest(docs.limit(0), PATH).collect() == []
    ids = streambpe.encode_texts(docs, PATH)
    back = streambpe.decode_ids(ids, PATH)
    assert sorted(map(repr, back.collect())) == sorted(repr((r[0], r[1] or "")).replace("(", "Row(doc_id=", 1).replace(", ", ", text=", 1) for r in rows)


def test_other_files_are_refused():
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        streambpe.Vocabulary(spec)
    with pytest.raises(ValueError):
        streambpe.vocabulary_of(public_tokenizers.path("word_bpe_49k.json"))

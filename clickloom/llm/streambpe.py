"""Byte-level BPE as a transducer with bounded lookahead, and a decoder that streams.

A token may be put out as soon as no later byte can change it. How many bytes that takes follows
from the merge list alone (``lookahead``): a change of tokens at some place can only reach the token
to its left through a later merge whose right operand begins with the token that changed, so the
reach is the longest chain of such merges. The encoder therefore works on a window of bytes: it
merges the window, puts out the tokens that end more than ``lookahead`` bytes before its end, and
starts the next window at that boundary (no merge crosses a boundary, so what is left is encoded as
before). Text is cut by the tokenizer's own pattern; a piece is handed on once no later character
can change it, and a piece that does not end is handed on while it grows. Memory does not depend on
the length of a text or of a piece.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bound_batches
from clickloom.llm.words import SLICE_BYTES

BLOCK_CHARS = 1 << 16  # characters taken from a text at a time
OPEN_CHARS = 1 << 10  # a piece of more characters is handed on while it grows
MEMO_PIECES = 1 << 19  # encoded pieces a worker remembers
MEMO_CHARS = 64  # longer pieces are not remembered
SETTLE_CHARS = 4  # characters that decide the start of a piece (a contraction such as 're, and one more)

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
CLASSES = {"letter": regex.compile(r"\p{L}*"), "number": regex.compile(r"\p{N}*"),
           "space": regex.compile(r"\s*"), "other": regex.compile(r"[^\s\p{L}\p{N}]*")}
SHORT = 64  # bytes up to which a plain search for the next merge is quicker than a heap
_NONE = 1 << 62
_ID = (1 << 32) - 1
STAND_IN = {"letter": "a", "number": "1", "space": "\t", "other": "!"}
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 byte values.

    Printable Latin-1 bytes stand for themselves, the others follow from code point 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that decide it, for merges in order of rank.

    ``reach[t]`` is how far left of the open end a difference may have gone when the token at its
    edge is ``t`` in one continuation and not in another. A merge (u, v) carries it on by len(u) if v
    is, or began as, such a token; otherwise v itself lies beyond the open end.
    """
    first: dict[bytes, bytes] = {}  # token: the token it began as
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        far, part = 0, v
        while part is not None:
            far = max(far, reach.get(part, 0))
            part = first.get(part)
        far += len(u)
        first[u + v] = u
        reach[u] = max(reach.get(u, 0), far)
        reach[u + v] = max(reach.get(u + v, 0), far)
        most = max(most, far)
    return most


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: dict, probe: Callable[[str], int] | None = None):
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and not spec.get("post_processor")
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and (spec.get("decoder") or {}).get("type") == "ByteLevel"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        ids = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        made = {token: -1 for token in letters}
        for rank, (u, v) in enumerate(pairs):
            if u + v in made or u not in made or v not in made:
                raise ValueError("a merge comes before its parts or makes a token twice")
            made[u + v] = rank
            self.pairs[ids[u], ids[v]] = (rank, ids[u + v])
        self.keyed = {pair: rank << 32 | made for pair, (rank, made) in self.pairs.items()}
        self.of_byte = [ids[letter] for letter, _ in sorted(letters.items(), key=lambda kv: kv[1])]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text: dict[int, bytes] = {n: bytes(letters[c] for c in t) for t, n in ids.items() if t not in self.special}
        self.text |= {n: t.encode() for t, n in self.special.items()}
        self.ahead = lookahead([(self.text[ids[u]], self.text[ids[v]]) for u, v in pairs])
        self.memo = _Memo(self)
        self._probe = probe
        self._seen: dict[str, str] = {}
        self._odd: set[str] = set()

    def merged(self, data: bytes) -> list[int]:
        """All merges of a byte string, lowest rank first and leftmost among equals."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) < SHORT:
            return self._merged_short(ids)
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.pairs[p], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, made, k, pair = heapq.heappop(heap)
            j = after[k]
            if j >= n or (ids[k], ids[j]) != pair:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (p := (made, ids[after[k]])) in self.pairs:
                    heapq.heappush(heap, (*self.pairs[p], k, p))
            if before[k] >= 0 and (p := (ids[before[k]], made)) in self.pairs:
                heapq.heappush(heap, (*self.pairs[p], before[k], p))
        return [i for i in ids if i >= 0]

    def _merged_short(self, ids: list[int]) -> list[int]:
        find = self.keyed.get
        keys = [find(pair, _NONE) for pair in zip(ids, ids[1:])]
        while keys:
            key = min(keys)
            if key == _NONE:
                break
            k = keys.index(key)
            made = ids[k] = key & _ID
            del ids[k + 1], keys[k]
            if k:
                keys[k - 1] = find((ids[k - 1], made), _NONE)
            if k < len(keys):
                keys[k] = find((made, ids[k + 1]), _NONE)
        return ids

    def class_of(self, c: str) -> str:
        """Letter, number, space or other, as the library sees it (its Unicode tables may be older)."""
        own = next((k for k in ("letter", "number", "space") if CLASSES[k].fullmatch(c)), "other")
        if not self._probe:
            return own
        together = {"letter": "a", "number": "1", "other": "!"}
        return next((k for k, lead in together.items() if self._probe(lead + c) == 1), "space")

    def stand_in(self, text: str) -> str:
        """``text`` with a plain character of the same class for each character that the two see differently."""
        if text.isascii():
            return text
        letters = set(text)
        for c in letters.difference(self._seen):
            kind = "other" if c == "'" else self.class_of(c)
            self._seen[c] = kind
            if not CLASSES[kind].fullmatch(c):
                self._odd.add(c)
        odd = letters & self._odd
        return text.translate({ord(c): STAND_IN[self._seen[c]] for c in odd}) if odd else text


class _Memo:
    """Pieces already encoded: the ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def encoded(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            return b"".join(self._learnt(piece) for piece in pieces)

    def _learnt(self, piece: str) -> bytes:
        out = self.known.get(piece)
        if out is None:
            data = piece.encode("utf-8", "surrogatepass")
            if len(data) <= self.vocabulary.ahead:  # nothing of it settles before its end
                out = array("I", self.vocabulary.merged(data)).tobytes()
            else:
                window = Window(self.vocabulary)
                out = window.feed(data) + window.finish()
            if len(piece) <= MEMO_CHARS:
                if len(self.known) >= MEMO_PIECES:
                    self.known.clear()
                self.known[piece] = out
        return out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Window:
    """Encodes the bytes of one piece: tokens leave as soon as no later byte can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, data: bytes) -> bytes:
        """Take bytes, return the ids settled by now; at most five lookaheads of bytes are held."""
        ahead, out = self.vocabulary.ahead, []
        step = 4 * ahead
        for k in range(0, len(data), step):
            self.held += data[k : k + step]
            if len(self.held) > step + ahead:
                out.append(self._settled(len(self.held) - ahead))
        return b"".join(out)

    def _settled(self, upto: int) -> bytes:
        ids, end = [], 0
        for token in self.vocabulary.merged(self.held):
            if end + len(self.vocabulary.text[token]) > upto:
                break
            ids.append(token)
            end += len(self.vocabulary.text[token])
        self.held = self.held[end:]
        return _packed(ids)

    def finish(self) -> bytes:
        """The ids of what is held: nothing follows."""
        ids = self.vocabulary.merged(self.held)
        self.held = b""
        return _packed(ids)


class Encoder:
    """Text in, ids out, both in parts of any size."""

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        """``plain``: special tokens written in a text are ordinary text."""
        self.vocabulary = vocabulary
        special = [] if plain else sorted(vocabulary.special, key=len, reverse=True)
        self.find = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.keep = max(map(len, special), default=1) - 1
        self.held = ""  # may begin a special token
        self.tail = ""  # may belong to a piece that goes on
        self.open: tuple[str, Window] | None = None  # class and window of a piece that goes on

    def feed(self, text: str) -> bytes:
        return self._take(text, False)

    def finish(self) -> bytes:
        return self._take("", True)

    def _take(self, text: str, last: bool) -> bytes:
        text, out, at = self.held + text, [], 0
        for match in self.find.finditer(text):
            out += [self._pieces(text[at : match.start()], True), _packed([self.vocabulary.special[match[0]]])]
            at = match.end()
        upto = len(text) if last else max(at, len(text) - self.keep)
        out.append(self._pieces(text[at:upto], last))
        self.held = text[upto:]
        return b"".join(out)

    def _pieces(self, text: str, last: bool) -> bytes:
        text = self.tail + text
        self.tail, out = "", []
        if self.open:
            text = self._go_on(text, last, out)
            if self.open:
                return b"".join(out)
        shown = self.vocabulary.stand_in(text)
        pieces = (ASCII_PATTERN if text.isascii() else PATTERN).findall(shown)
        if shown is not text:
            at, own = 0, []
            for piece in pieces:
                own.append(text[at : at + len(piece)])
                at += len(piece)
            pieces = own
        if not last:
            left = 0
            while pieces and left < SETTLE_CHARS:
                left += len(pieces.pop())
            self.tail = text[len(text) - left :] if left else ""
        out.append(self.vocabulary.memo.encoded(pieces))
        if len(self.tail) > OPEN_CHARS:
            self._open(out)
        return b"".join(out)

    def _open(self, out: list[bytes]) -> None:
        """Hand on the first piece of the tail if it reaches the tail's end."""
        shown = self.vocabulary.stand_in(self.tail)
        if PATTERN.match(shown).end() < len(shown):
            return
        kind = next(k for k, c in CLASSES.items() if c.fullmatch(shown[-1]))
        self.open = kind, Window(self.vocabulary)
        text, self.tail = self.tail, ""
        self.tail = self._go_on(text, False, out, skip=1)

    def _go_on(self, text: str, last: bool, out: list[bytes], skip: int = 0) -> str:
        """Feed the open piece; what follows it is returned. White space leaves its last character
        to the next piece unless the text ends."""
        kind, window = self.open
        end = CLASSES[kind].match(self.vocabulary.stand_in(text), skip).end()
        ended = last or end < len(text)
        if kind == "space" and not (last and end == len(text)):
            end = max(end - 1, 0)
        out.append(window.feed(text[:end].encode("utf-8", "surrogatepass")))
        if ended:
            out.append(window.finish())
            self.open = None
        else:
            self.tail = text[end:]
        return text[end:]


class Decoder:
    """Ids in, text out: bytes of an unfinished character wait, invalid ones become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        """Ids outside the vocabulary stand for nothing."""
        try:
            data = b"".join(map(self.vocabulary.text.__getitem__, ids))
        except KeyError:
            data = b"".join(self.vocabulary.text.get(i, b"") for i in ids)
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary of a file, once per worker; truncation and padding stay unused."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter = Tokenizer.from_file(path).pre_tokenizer
    return Vocabulary(spec, lambda text: len(cutter.pre_tokenize_str(text)))


def encoded_parts(vocabulary: Vocabulary, text: str, plain: bool = False) -> Iterator[bytes]:
    """The ids of a text as they settle."""
    encoder = Encoder(vocabulary, plain)
    for k in range(0, len(text), BLOCK_CHARS):
        yield encoder.feed(text[k : k + BLOCK_CHARS])
    yield encoder.finish()


def _digest(vocabulary: Vocabulary, text: str) -> tuple[int, str, str]:
    own, back, n = hashlib.sha256(), hashlib.sha256(), 0
    decoder = Decoder(vocabulary)
    for part in encoded_parts(vocabulary, text):
        n += len(part) // 4
        own.update(part)
        back.update(decoder.feed(np.frombuffer(part, "<u4").tolist()).encode())
    back.update(decoder.finish().encode())
    return n, own.hexdigest(), back.hexdigest()


def _rows(docs: DataFrame, id_col: str, column: str, out: str, schema: str, work: Callable) -> DataFrame:
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{column}`").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            first = 0
            while first < batch.num_rows:  # a few values at a time, one long value alone
                last, size = first, 0
                while last < batch.num_rows and (size < SLICE_BYTES or last == first):
                    value = values[last]
                    size += len(value.as_buffer()) if isinstance(value, pa.StringScalar) and value.is_valid else 64
                    last += 1
                rows = [work(v) for v in values.slice(first, last - first).to_pylist()]
                columns = [ids.slice(first, last - first), *(list(c) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) if isinstance(c, list) else c for c, t in zip(columns, types, strict=True)],
                    names=names,
                )
                first = last

    fields = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(fields))
    names, types = arrow.names, arrow.types
    return own.mapInArrow(run, fields)


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every text; a null text has no ids, like an empty one."""

    def work(text: str | None):
        parts = b"".join(encoded_parts(vocabulary_of(tokenizer), text or ""))
        return (np.frombuffer(parts, "<u4").astype(np.int32),)

    return _rows(docs, id_col, text_col, "text", "ids array<int>", work)


def decode_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and the text that the ids stand for; null ids give an empty text."""

    def work(ids: list[int] | None):
        decoder = Decoder(vocabulary_of(tokenizer))
        return (decoder.feed([i for i in ids or [] if i is not None]) + decoder.finish(),)

    return _rows(docs, id_col, ids_col, "ids", "text string", work)


def coding_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ids counted and hashed while they settle, and the hash of the text decoded from them.

    Rows stay rows: repeated rows and null ids appear as often as they come, ties do not arise, an
    empty table gives an empty table. A null text counts as empty: no ids, the hash of nothing. A very
    long text passes in blocks. Columns other than the two named are not read, so their names
    cannot clash. Special tokens written in a text are single ids, as the library has it.
    """

    def work(text: str | None):
        return _digest(vocabulary_of(tokenizer), text or "")

    return _rows(docs, id_col, text_col, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", work)

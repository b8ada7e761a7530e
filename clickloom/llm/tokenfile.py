"""Token ids in files of bit-plane shuffled blocks.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK_IDS``. A block is
transposed into planes: plane p holds bit p (or byte p) of every id. Each plane is compressed with
zstandard on its own, so planes that never change cost almost nothing. After the blocks come the
document index (ids and counts) and the chunk index (offset of every block and length of every
plane), then a fixed footer. A reader decodes only the blocks that cover the documents it wants.

Layout, little-endian: magic, blocks, document index, chunk index, footer.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import bound_batches, fresh_path, materialize, store_of

MAGIC = b"BITPLN01"
FOOTER = struct.Struct("<QQQQBBI8s")  # document index at, chunk index at, ids, documents, unit, planes, block ids, magic
BLOCK_IDS = 1 << 16
END_ID = 1
CACHE_PIECES = 1 << 18

PART = "file string, first_doc long, last_doc long, n_docs long, n_ids long"
DOC = "doc_id long, start long, n_tokens long, ids_crc32 long"


def planes_of(ids: np.ndarray, unit: int, planes: int) -> list[bytes]:
    """Transpose ids into ``planes`` planes of ``unit`` (1: bits, 8: bytes)."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        return [raw[:, p].tobytes() for p in range(planes)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(planes)]


def ids_of(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    """The inverse of ``planes_of``."""
    if unit == 8:
        raw = np.zeros((n, 4), np.uint8)
        for p, plane in enumerate(planes):
            raw[:, p] = np.frombuffer(plane, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for p, plane in enumerate(planes):
        bits[:, p] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Streams documents into one file; holds one block and the indexes."""

    def __init__(self, out, unit: int = 8, vocabulary: int = 1 << 16, block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.unit, self.block_ids = out, unit, block_ids
        self.planes = -(-max(1, (vocabulary - 1).bit_length()) // unit)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held, self.ids = len(MAGIC), [], 0, 0
        self.docs, self.counts, self.chunks = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.ids += len(ids)
        while len(ids):
            part = ids[: self.block_ids - self.n_held]
            self.held.append(part)
            self.n_held += len(part)
            ids = ids[len(part) :]
            if self.n_held == self.block_ids:
                self._block()

    def _block(self) -> None:
        packed = [self.packer.compress(p) for p in planes_of(np.concatenate(self.held), self.unit, self.planes)]
        self.chunks.append([self.at, *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._block()
        known = np.array([d is not None for d in self.docs], np.uint8).tobytes()
        names = np.array([d or 0 for d in self.docs], "<i8").tobytes()
        index = self.packer.compress(known + names + np.array(self.counts, "<u8").tobytes())
        chunk = self.packer.compress(np.array(self.chunks, "<u8").tobytes())
        self.out.write(index + chunk)
        self.out.write(
            FOOTER.pack(self.at, self.at + len(index), self.ids, len(self.docs), self.unit, self.planes, self.block_ids, MAGIC)
        )


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, os.SEEK_END)
        end = file.tell() - FOOTER.size
        file.seek(end)
        docs_at, chunks_at, self.n_ids, n, self.unit, self.planes, self.block_ids, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        unpack = zstandard.ZstdDecompressor()
        file.seek(docs_at)
        index = unpack.decompress(file.read(chunks_at - docs_at))
        known = np.frombuffer(index[:n], np.uint8).astype(bool)
        names = np.frombuffer(index[n : 9 * n], "<i8")
        self.docs = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(index[9 * n :], "<u8").astype(np.int64))])
        self.chunks = np.frombuffer(unpack.decompress(file.read(end - chunks_at)), "<u8").reshape(-1, 1 + self.planes)
        self.unpack, self.kept = unpack, (-1, None)

    def block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            at, *lengths = (int(x) for x in self.chunks[k])
            self.file.seek(at)
            parts = [self.unpack.decompress(self.file.read(n)) for n in lengths]
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            self.kept = k, ids_of(parts, n, self.unit)
        return self.kept[1]

    def document(self, k: int) -> np.ndarray:
        lo, hi = int(self.starts[k]), int(self.starts[k + 1])
        parts = []
        while lo < hi:
            b = lo // self.block_ids
            stop = min(hi, (b + 1) * self.block_ids)
            parts.append(self.block(b)[lo - b * self.block_ids : stop - b * self.block_ids])
            lo = stop
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_PLAIN = re.compile(rf"[\t\n\r -~{_LATIN}]*")  # composed letters on whose classes all libraries agree
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies have for each byte: itself, or the next
    free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Encodes whole texts with the tokenizer file; remembers the ids of what it has seen.

    A text of ASCII and composed Latin letters without an added token is put in lower case and cut
    into the pieces of the file's own pattern, and the library's model encodes each distinct piece
    once. Any other text goes to the library whole. Both ways give the same ids; files with
    another normaliser or pattern must be read with ``whole=True``.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for text in texts:
            text = text or ""
            if self.whole or "<|" in text or not _PLAIN.fullmatch(text):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                continue
            pieces = _PIECE.findall(text.lower())
            new = set(pieces).difference(self.known)
            if len(self.known) + len(new) > CACHE_PIECES:
                self.known.clear()
                new = set(pieces)
            for piece in new:
                spelled = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
                ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
                self.known[piece] = np.array(ids, "<u4").tobytes()
            yield np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker, so that what it remembers serves its later tasks too."""
    return Encoder(path)


def _write(folder: str, path: str, unit: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, out = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode = encoder(path)
                store, base = store_of(folder)
                store.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.ids"  # of this attempt: a lost one leaves no row
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = Writer(out, unit, max(encode.tokenizer.get_vocab_size(), end_id + 1))
            texts = batch.column("text").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                writer.add(doc, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            ends = [d for d in (writer.docs[0], writer.docs[-1])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.string()),
                    *(pa.array([v], pa.int64()) for v in (*ends, len(writer.docs), writer.ids)),
                ],
                names=[f.split()[0] for f in PART.split(", ")],
            )

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, unit: int = 8,
) -> DataFrame:
    """Encode every text and write files in ascending id order; returns the stored list of files:
    file, first_doc, last_doc, n_docs, n_ids, part (their order).

    Texts of one id follow each other by text; a null id comes first; a null text has the end id
    only. Only files in the list count: a repeated task writes a file of its own.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = own.repartitionByRange("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    ordered = ordered.sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    files = ordered.mapInArrow(_write(folder, tokenizer, unit, end_id), PART)
    return materialize(files.withColumn("part", F.monotonically_increasing_id()), "token-files")


def _read(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder_path = store_of(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{folder_path}/{name}") as file:
                    reader = Reader(file)
                    rows = []
                    for k, doc in enumerate(reader.docs):
                        ids = reader.document(k)
                        rows.append((doc, base + int(reader.starts[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                    names=[f.split()[0] for f in DOC.split(", ")],
                )

    return run


def read_digest(files: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids before the document), n_tokens, ids_crc32.

    A file's row brings the ids before the file along, so documents need no join.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    bases = materialize(bases, "file-starts")
    dealt = bases.repartition(files.sparkSession.sparkContext.defaultParallelism * 2, "file")
    return dealt.mapInArrow(_read(folder), DOC)


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to files of a new folder and read their digest back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_digest(write_tokens(docs, folder, tokenizer, id_col, text_col), folder)

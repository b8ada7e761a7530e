"""WARC archives of pages, and a globally ordered capture index merged from sorted runs.

Each task writes one archive (a gzip member per record) and hands on its capture index as a run
sorted by URL key and time. Runs are cut at common key ranges; a task merges its slices of all
runs with a loser tree. Ranges are over (URL key, time, page), so one URL with very many captures
is cut as well. Payloads are never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import (
    bitmap_of,
    bound_batches,
    fresh_path,
    materialize,
    maybe_in,
    row_keys,
    split_join,
    store_of,
    where_maybe,
)

LEAST_BYTES = 100  # shorter payloads are always stored
LEVEL = 3  # of gzip: half the time of the usual 6 for a few per cent more bytes
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RUN = "run string, at long, length long, url_key string, captured string, page_id long"
CAPTURE = RUN + ", payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/').lower()}{query}"


def capture_time(page_id: int | None) -> str:
    """Pages carry no time: one second per id after a fixed start stands for it."""
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    again = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if again else head + payload
    target = "".join((url or "").split())
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", capture_time(page_id)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if again:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
        ]
    fields.append(("Content-Length", str(len(body))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def read_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, payload length of the capture, and the stored payload of one record."""
    raw = zlib.decompress(data, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    head, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))
    return fields, length, payload


def _writer(folder: str, skip=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes one archive per task attempt; only rows that the task hands on name valid archives.

    With a bitmap ``skip``, rows that may be in it are left to another pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at, rows = None, 0, []
        for batch in batches:
            if skip is not None and batch.num_rows:
                batch = batch.filter(pa.array(~maybe_in(skip.value, batch.column("row_a").to_numpy())))
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
            for page, url, html, digest, refers in zip(*columns, strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers)
                out.write(data)
                rows.append((name, at, len(data), url_key(url), capture_time(page), page))
                at += len(data)
        if out is not None:
            out.close()
            rows.sort(key=_order)  # the run
            yield _batch(rows, RUN)

    return run


def _order(row: tuple) -> tuple:
    return (row[3], row[4], row[5] is not None, row[5] or 0, row[0], row[1])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def merge(runs: list[list[tuple]], order: Callable[[tuple], tuple] = _order) -> Iterator[tuple]:
    """K-way merge of sorted runs with a loser tree: one replayed path per row, log2(k) compares."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    current: list[tuple | None] = [next(h, None) for h in heads]
    keys = [order(c) if c is not None else None for c in current]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and keys[a] is not None
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * k
    winner = -1
    for leaf in range(k):  # play each leaf up to the first free node
        player, node = leaf, (leaf + k) // 2
        while node > 0:
            if losers[node] < 0:
                losers[node] = player
                player = -1
                break
            if beats(losers[node], player):
                losers[node], player = player, losers[node]
            node //= 2
        if player >= 0:
            winner = player
    while current[winner] is not None:
        yield current[winner]
        current[winner] = next(heads[winner], None)
        keys[winner] = order(current[winner]) if current[winner] is not None else None
        player, node = winner, (winner + k) // 2
        while node > 0:
            if beats(losers[node], player):
                losers[node], player = player, losers[node]
            node //= 2
        winner = player


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the slices of all runs in one key range; a range is bounded by its exchange.

    The exchange may hand on a run's rows in pieces, so each slice arrives sorted anew."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[0], []).append(row)
    rows = []
    for row in merge([runs[name] for name in sorted(runs)]):
        rows.append(row)
        if len(rows) == 4096:
            yield _batch(rows, RUN)
            rows = []
    if rows:
        yield _batch(rows, RUN)


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Read each indexed record back and check its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != name:
                    if file:
                        file.close()
                    name, file = row[0], store.open_input_file(f"{base}/{row[0]}")
                file.seek(row[1])
                fields, length, payload = read_record(file.read(row[2]))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                    raise ValueError(f"damaged payload in {row[0]} at {row[1]}")
                page = fields["WARC-Page-ID"]
                refers = fields.get("WARC-Refers-To-Page-ID")
                rows.append((*row[:5], int(page) if page else None, length, digest, kind, int(refers) if refers else None))
            yield _batch(rows, CAPTURE)
        if file:
            file.close()

    return run


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages into archives under ``folder``; returns the runs (one sorted run per archive).

    Of pages with equal payloads of ``LEAST_BYTES`` or more, the smallest page_id is stored and
    the others become revisits of it. Rows with a null id never count as smallest.
    """
    bound_batches(pages.sparkSession)
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    own = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), *row_keys(id_col, url_col, html_col),
    )
    slim = own.where(F.octet_length("html") >= LEAST_BYTES).select("row_a", "row_b", "page_id", "digest")
    slim = materialize(slim, "payloads")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = (
        split_join(slim, first, ["digest"], "inner", "first-captures")
        .where("refers_to is not null and not page_id <=> refers_to")
        .select("row_a", "row_b", "refers_to").distinct()
    )
    again = materialize(again, "revisits")
    doubtful = bitmap_of(again, "row_a")
    fresh = own.withColumn("refers_to", F.lit(None).cast("long")).mapInArrow(_writer(folder, doubtful), RUN)
    others = where_maybe(own, "row_a", doubtful).join(again, ["row_a", "row_b"], "left")
    return materialize(fresh.union(others.mapInArrow(_writer(folder), RUN)), "capture-runs")


def capture_history(runs: DataFrame) -> DataFrame:
    """The runs merged into one index, ordered by URL key, time and page over all partitions."""
    sliced = runs.repartitionByRange("url_key", "captured", "page_id", "run", "at")
    return sliced.sortWithinPartitions("run", "url_key", "captured", "page_id", "at").mapInArrow(_merge_slices, RUN)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive the pages, merge the index, and read every capture back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url_key, captured, order_no (ascending over the whole
    history). Repeated rows are captures of their own; a null payload is empty; an empty table
    gives an empty result; other columns are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    runs = archive(pages, folder, id_col, url_col, html_col)
    index = materialize(capture_history(runs).withColumn("order_no", F.monotonically_increasing_id()), "capture-index")
    where = index.select(*(f.split()[0] for f in RUN.split(", ")))
    read = where.repartition("run").sortWithinPartitions("run", "at").mapInArrow(_reader(folder), CAPTURE)
    place = index.select("run", "at", "order_no")
    return read.join(place, ["run", "at"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "order_no"
    )

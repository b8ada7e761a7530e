"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by label path (tag and names of each element from the root).
Presentation: how evenly a node's child sequences spread over the pages that have it. Content: how
evenly a text spreads over pages. Entropy with base (number of pages) makes both 0 to 1: content
found on every page has importance 0, content found once 1. A branch's importance joins both, its
own presentation and what lies below, with weight ``DECAY`` per level. Branches and blocks of low
importance are removed from each page, besides those that page structure marks as noise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bitmap_of, bound_batches, materialize, maybe_in, row_keys, split_join
from clickloom.llm.dom import content_blocks, parse

DECAY = 0.9
LOW = 0.3  # importance below this is noise
LEAST_PAGES = 5  # unlike pages that must show a text before it can be noise

_TREE = (
    "row_a long, row_b long, host string, set_a long, set_b long, blocks array<struct<path:string,text:long,chars:long>>, "
    "styles array<struct<path:string,style:long>>"
)
_TEXT = "page_id long, url string, text string, n_chars long"


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def list_hash(found: list) -> tuple[int, int]:
    """Two 64-bit hashes that stand for a page's whole list of blocks."""
    lines = "\n".join(f"{b.element.path}\t{b.text}" for b in found)
    digest = hashlib.md5(lines.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.int64()), ("chars", pa.int64())]))
    style = pa.list_(pa.struct([("path", pa.string()), ("style", pa.int64())]))
    for batch in batches:
        blocks, styles, sets = [], [], []
        for html in batch.column("html").to_pylist():
            found, elements = parse(html or "")
            own = {(b.element.path, text_hash(b.text)): len(b.text) for b in found}
            blocks.append([{"path": p, "text": t, "chars": n} for (p, t), n in own.items()])
            sets.append(list_hash(found))
            seen = {}
            for e in elements:
                if e.children:  # runs of equal children count once
                    seq = [c for k, c in enumerate(e.children) if not k or c != e.children[k - 1]]
                    seen[e.path] = text_hash(" ".join(seq))
            styles.append([{"path": p, "style": s} for p, s in seen.items()])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row_a", "row_b", "host")),
             *(pa.array([m[k] for m in sets], pa.int64()) for k in (0, 1)), pa.array(blocks, block), pa.array(styles, style)],
            names=["row_a", "row_b", "host", "set_a", "set_b", "blocks", "styles"],
        )


def _text_of(html: str | None, noise: set[tuple[str, int]]) -> str:
    """``noise`` has the path and the text hash of what goes; the same text elsewhere stays."""
    found = content_blocks(html or "")
    return "\n\n".join(b.text for b, fine in found if fine and (b.element.path, text_hash(b.text)) not in noise)


def _extract(doubtful, wanted: bool):
    """Texts of the pages that are (or are not) maybe in the bitmap; ``noise`` lists what goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if not wanted:
                met = maybe_in(doubtful.value, batch.column("row_a").to_numpy())
                batch = batch.filter(pa.array(~met))
            noise = batch.column("noise").to_pylist() if wanted else [None] * batch.num_rows
            texts = [_text_of(h, {(x["path"], x["text"]) for x in n or ()}) for h, n in zip(batch.column("html").to_pylist(), noise, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()),
                    pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def _keep(doubtful):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(maybe_in(doubtful.value, batch.column("row_a").to_numpy())))

    return run


def style_tree(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Importance of texts (host, path, text, importance, pages) and of nodes (host, path, importance).

    Pages of a host with the same list of blocks count as one, so copies of a page do not make its
    text look like a template; near copies count each.
    """
    pages = trees.groupBy("host").agg(F.countDistinct("set_a", "set_b").alias("m"))
    pages = materialize(pages, "host-pages")
    rows = trees.select("host", "set_a", "set_b", F.explode("blocks").alias("b")).select(
        "host", "set_a", "set_b", F.col("b.path").alias("path"), F.col("b.text").alias("text"), F.col("b.chars").alias("chars")
    )
    texts = (
        rows.distinct().groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("pages"), F.max("chars").alias("chars"))
        .join(pages, "host")
        .withColumn("importance", F.lit(1.0) - F.when(F.col("m") > 1, F.ln("pages") / F.ln("m")).otherwise(0.0))
    )
    texts = materialize(texts, "text-importance")
    styles = (
        trees.select("host", F.explode("styles").alias("s")).select("host", "s.path", "s.style")
        .groupBy("host", "path", "style").agg(F.count(F.lit(1)).alias("n"))
    )
    spread = styles.groupBy("host", "path").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("nlogn")
    ).select(
        "host", "path",
        F.when(F.col("m") > 1, F.lit(1.0) - F.col("nlogn") / (F.col("m") * F.ln("m"))).otherwise(1.0).alias("presentation"),
    )
    leaves = texts.groupBy("host", "path").agg(
        F.sum(F.col("importance") * F.col("pages") * F.col("chars")).alias("value"),
        F.sum(F.col("pages") * F.col("chars")).alias("weight"),
        F.max("pages").alias("pages"),
    )
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (F.size(parts) - i).alias("below")),
    )
    nodes = (
        leaves.select("host", "value", "weight", "pages", F.explode(above).alias("a"))
        .groupBy("host", F.col("a.path").alias("path"))
        .agg((F.sum("value") / F.sum("weight")).alias("content"), F.max("a.below").alias("levels"), F.max("pages").alias("pages"))
        .join(spread, ["host", "path"], "left")
    )
    share = F.pow(F.lit(DECAY), F.col("levels"))
    nodes = nodes.select(
        "host", "path", "pages",
        (F.coalesce("presentation", F.lit(1.0)) * (1 - share) + F.col("content") * share).alias("importance"),
    )
    return texts, nodes


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by two line feeds), n_chars.

    A null or empty page gives an empty text; a null url is the host ''. Repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    own = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").alias("html"), *row_keys(id_col, url_col, html_col),
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    trees = materialize(own.select("row_a", "row_b", host.alias("host"), "html").mapInArrow(_trees, _TREE), "trees")
    texts, nodes = style_tree(trees)

    dull = nodes.where((F.col("importance") < LOW) & (F.col("pages") >= LEAST_PAGES)).select("host", F.col("path").alias("dull"))
    low_branch = texts.join(dull, "host").where(
        (F.col("path") == F.col("dull")) | F.col("path").startswith(F.concat("dull", F.lit("/")))
    )
    low_text = texts.where((F.col("importance") < LOW) & (F.col("pages") >= LEAST_PAGES))
    noise = low_text.select("host", "path", "text").union(low_branch.select("host", "path", "text")).distinct()
    rows = trees.select("row_a", "row_b", "host", F.explode("blocks").alias("b"))
    rows = rows.select("row_a", "row_b", "host", "b.path", "b.text")
    found = materialize(
        split_join(rows, noise, ["host", "path", "text"], "inner", "noise")
        .groupBy("row_a", "row_b").agg(F.collect_set(F.struct("path", "text")).alias("noise")),  # at most the page's own blocks
        "page-noise",
    )
    doubtful = bitmap_of(found, "row_a")
    plain = own.mapInArrow(_extract(doubtful, False), _TEXT)
    suspect = own.mapInArrow(_keep(doubtful), own.schema).join(found, ["row_a", "row_b"], "left")
    return plain.union(suspect.mapInArrow(_extract(doubtful, True), _TEXT))

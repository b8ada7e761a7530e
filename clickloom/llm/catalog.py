"""The operators as named queries over the shared tables, and their expected results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm.alignment import alignment_digest
from clickloom.llm.catalog_sql import ORACLE
from clickloom.llm.common import read_table
from clickloom.llm.decontam import contaminations
from clickloom.llm.langmix import predict_languages
from clickloom.llm.linefreq import line_rules
from clickloom.llm.mixing import mixed
from clickloom.llm.neardup import near_duplicates
from clickloom.llm.runs import run_digest
from clickloom.llm.shards import shard_table
from clickloom.llm.sitestyle import main_text
from clickloom.llm.streambpe import coding_digest
from clickloom.llm.tokenfile import token_table
from clickloom.llm.toolcalls import link_tool_calls
from clickloom.llm.warc import archived_pages

__all__ = ["ORACLE", "QUERIES"]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_site_style_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(read_table(spark, sf_dir, "pages"))


def op3_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    return token_table(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return predict_languages(read_table(spark, sf_dir, "documents"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_table(read_table(spark, sf_dir, "documents"))


def op6_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    return line_rules(read_table(spark, sf_dir, "documents"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document."""
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as canonical JSON with its tool links."""
    return link_tool_calls(read_table(spark, sf_dir, "conversations"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture of its sources."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs, key=["doc_id"])


def op10_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back through the merged capture index."""
    found = archived_pages(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, one in ten of them made periodic."""
    return run_digest(read_table(spark, sf_dir, "documents"))


def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of two tokenizers in every document, with corpus counts of the linked pairs."""
    docs = read_table(spark, sf_dir, "documents")
    return alignment_digest(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, hashed while they stream."""
    return coding_digest(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; workers find the same path on their machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_site_style_text,
        op3_bit_plane_tokens,
        op4_language_mixture,
        op5_feistel_shards,
        op6_line_frequency_rules,
        op7_simhash_decontamination,
        op8_tool_call_links,
        op9_pfair_mixing,
        op10_warc_history,
        op11_periodic_runs,
        op12_pair_bitmaps,
        op13_streaming_bpe,
    )
}

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosenpath, covertree, decontam, importance, langid, mixing, multiindex, spelling, substring, tokens, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.join(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_copies(_table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """The public tokenizer that op7 uses; the module that knows its place is installed beside it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_mix_sources,
    op2_toxicity,
    op3_substring_dedup,
    op4_language_id,
    op5_jaccard_join,
    op6_embedding_dedup,
    op7_token_output,
    op8_warc,
    op9_url_filter,
    op10_decontamination,
    op11_spelling_variants,
    op12_importance_resampling,
    op13_exact_top_k,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_exact_top_k": covertree.ORACLE,
}

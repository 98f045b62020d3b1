"""The registered queries of the training-data operators.

Each applies one operator, with production parameters, to its whole table and
derives the agreed digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; any other path serves as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(documents.where(~held_out))
    return language_id.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "examples", "cosines")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), vocabulary=tokenizer_path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = quality.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score_quality(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_similar", "component_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    found = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "n_fallback", F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), "decoded_crc32", "round_trip", "n_unlike")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import byte_level_vocabulary, token_counts

    return token_counts(table(spark, sf_dir, "documents"), *byte_level_vocabulary(tokenizer_path("byte_bpe_50k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {name[: -len("_sql")]: sql for name, sql in vars(oracles).items() if name.endswith("_sql")}

"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations
from .common import table, tune
from .cover import SQL as COVER_SQL
from .cover import removed_words
from .fingerprints import edit_likeness
from .interaction import SQL as INTERACTION_SQL
from .interaction import filter_interactions
from .media import media_features
from .neardup import near_duplicates
from .negatives import SQL as NEGATIVES_SQL
from .negatives import hard_negatives
from .packing import pack_documents
from .pieces import encode_documents
from .pii import find_personal_data
from .sharding import SQL as SHARDING_SQL
from .sharding import compacted_documents
from .suffixes import removed_bytes
from .tokenizer_files import tokenizer_path
from .toxicity import score_documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted_documents(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(tune(spark), sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(tune(spark), sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(tune(spark), sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(tune(spark), sf_dir, "documents"), width=3, percent=85)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(tune(spark), sf_dir, "conversations"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(table(tune(spark), sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(tune(spark), sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(tune(spark), sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(table(tune(spark), sf_dir, "documents"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(tune(spark), sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_media": op2_media,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_pii": op4_pii,
    "op5_minhash": op5_minhash,
    "op6_chat": op6_chat,
    "op7_suffixes": op7_suffixes,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_cover": op11_cover,
    "op12_interaction": op12_interaction,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL: dict[str, str] = {"op1_sharding": SHARDING_SQL, "op11_cover": COVER_SQL, "op12_interaction": INTERACTION_SQL, "op13_negatives": NEGATIVES_SQL}

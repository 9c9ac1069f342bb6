"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bloom_lm, factor_machine, hard_negatives, oracle, pieces, pii, pu_quality, rank_index, token_blocks, warc
from .frames import prepared
from .mixing import mix
from .near_dedup import near_duplicates
from .nn_descent import near_vectors
from .order_minhash import edited_fingerprints


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The public vocabulary file; a parameter of the operator.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: The public tokenizer of op13, by name.
TOKENIZER = "byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentations(read(spark, sf_dir, "documents"), MODEL_FILE)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(read(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_machine.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(read(spark, sf_dir, "documents"), share=1.5, most=2.0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_index.digests(read(spark, sf_dir, "documents")).drop("n_segments")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read(spark, sf_dir, "embeddings"))


def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_blocks.stored(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_warc, op4_lm_score, op5_embedding_dedup, op6_toxicity, op7_fingerprints, op8_pii, op9_mixing, op10_near_dedup,
                                    op11_fill_in_middle, op12_hard_negatives, op13_token_blocks)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()

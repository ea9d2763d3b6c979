"""A training-data pipeline over ``documents``: (name, function) stages, each taking (spark, docs, sf_dir).

Toxic documents go, one document of each group of near copies stays, secrets are masked, sources are mixed to their
targets, and what is left is packed into windows of tokens. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm import mixing, ngram_join, packing, secret_scan, toxicity
from statweave.llm.common import checkpoint

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.7.

    Null and empty texts have no features and the score of the intercept alone; repeated rows are judged alike, rows
    without an id as all others (labels without an id teach nothing); no labels or no documents: nothing is toxic;
    other columns stay as they are, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.below(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at similarity 0.8 connect, one: the one with the least id.

    Where an id is null or repeated, rows count as documents of their own, equal rows as copies, and of a group the row
    stays that is read first. Null, empty and blank texts link with nothing and stay; an empty table stays empty;
    other columns stay as they are, whatever their names.
    """
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        parts = ngram_join.jaccard_components(docs, k=5, num=4, den=5)
        return docs.join(parts.where("doc_id = component_id").select(F.col("doc_id").alias("kept id")), F.col("doc_id") == F.col("kept id"), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = checkpoint(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("text").alias("text"), row.alias("row")))
    parts = ngram_join.jaccard_components(rows, k=5, num=4, den=5).where("doc_id = component_id").select("doc_id")
    kept = rows.join(parts, "doc_id", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars, if there, follows the text.

    Null and empty texts have none and stay; repeated rows, null ids and an empty table are as all others; other
    columns stay as they are, whatever their names.
    """
    return secret_scan.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each time, the one at a source's cut in part.

    Null and empty sources are two sources; null, empty and blank texts have no words and aren't taken; repeated rows
    are taken each for itself; an empty table stays empty; other columns are copied along, whatever their names.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4,096 tokens.

    Null and empty texts are the end token alone; null and empty sources are one queue; repeated rows and ids are
    packed each for itself, null ids stay null; an empty table gives no pieces; other columns are left behind.
    """
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_windows)]
#: Model scores, shingle hashes and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

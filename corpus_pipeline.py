"""The corpus pipeline: raw documents to packed token sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm import decontam, nearcopies, packing, quality, secrets
from pathlore.llm.common import exists, remove_folder, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base conditions or whose posterior quality is below one half.

    A null text has no words and fails; a null id stays null. Repeated rows are judged alike. An empty table stays empty.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word Jaccard 0.8 or more).

    Null and empty texts are copies of each other. A null id is kept only where a group has no other; of repeated rows any
    one. Texts of any length are compared whole. An empty table stays empty.
    """
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or with other slots.

    Null texts hold none. Rows with a null id stay. Repeated rows go or stay alike. With an empty benchmark all stay.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows, where there is such a column.

    Null texts stay null, and rows stay as many as they are. Time grows with a text's length and hits.
    """
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of 4096; a row for each piece, with its ids.

    A null text is an empty one, of one id. Repeated rows are documents of their own. An empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", sequence_packing),
]

#: Fingerprints, estimation and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; the last is not written.

    A run that is started again under its ``name`` goes on behind the last stage that was written
    whole. A stage's output is removed once the next one's is there.
    """
    folder, docs, done = f"{shared_folder(spark)}/pipeline-{name or uuid.uuid4().hex}", table(spark, sf_dir, "documents"), 0
    for k in range(len(STAGES) - 1):
        if exists(spark, f"{folder}/{k}/_SUCCESS"):
            docs, done = spark.read.parquet(f"{folder}/{k}"), k + 1
    for k, (_, stage) in list(enumerate(STAGES))[done:]:
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
    return docs

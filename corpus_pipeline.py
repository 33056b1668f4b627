"""A training corpus from raw documents: language, toxicity, near-duplicates, secrets, packing.

Every stage works on all rows its predecessor kept, which are written as Parquet and read again. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.lineage import shared_folder
from saldo.llm import langid, packing, secrets, simhash, toxicity
from saldo.llm.common import table
from saldo.llm.registry import held_out, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows go whose language the classifier rejects (no letter, null, or below its confidence bound)."""
    model = langid.fit(docs)
    said = langid.identify(docs.select(*COLUMNS), model)
    return said.where(~F.col("lang_rejected")).select(*COLUMNS)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rows go that score THRESHOLD or more; learned from the labels outside op8's held-out fold."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out("doc_id", 3, 1))
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels))
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup on five-word shingles, likeness 0.8: of each group the row of smallest doc_id stays (nulls last, then by content)."""
    return simhash.keep_first(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark, and n_chars follows; all rows stay."""
    found = secrets.scan(docs.select(*COLUMNS), secrets.train())
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all rows in sequences of 2048 tokens, as op7 returns them."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), emit=packing.crc32_ids, schema=packing.DIGEST)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_identified),
    ("toxicity", keep_civil),
    ("simhash", keep_one_of_each),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Classifiers and a tokenizer decide what stays; SQL can't express the stages.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir.

    Each stage's rows are written below spark.checkpoint.dir; a stage's folder goes once the next one is
    written. The last folder holds the result and is the caller's to remove.
    """
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        folder = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            _remove(spark, before)
        before = folder
    return docs

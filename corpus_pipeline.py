"""A pipeline of corpus stages; each stage's result is written as Parquet and read again as the next one's documents.

Stages keep the columns of documents, all but the last.  Counted as part of the subpackage llm.

Every stage takes null ids and texts, empty and very long texts, repeated rows, empty tables and further columns of any name:
null text is empty text (and stays null where it is not changed), a null id is a document of its own, and rows that repeat are
treated alike, but for the n-gram join, which keeps one row of each class.  Ties are broken as the operators' docstrings say.
"""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from tilelake.llm import linededup, ngram_join, packing, quality, secrets
from tilelake.llm.common import fold, shared_folder, ship, table
from tilelake.session import until_end

BPE = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)


def line_dedup(spark, docs, sf_dir):
    """Repeated multi-line chunks go from all but the first document; n_chars follows the text."""
    out = linededup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def ngram_jaccard_join(spark, docs, sf_dir):
    """One row of each class of texts stays: the one with the least id, null ids last."""
    ship(spark)
    return ngram_join.representatives(docs)


def secret_scan(spark, docs, sf_dir):
    """Secrets are replaced by a mark; every document stays."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def best_fit_packing(spark, docs, sf_dir):
    ship(spark)
    return packing.pack(docs, BPE)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: SQL cannot express the first stage (a trained network); tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to documents; what they write stays until the driver ends."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        until_end(spark, f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs

"""The registered queries of this folder: thin calls of the operators over whole tables."""

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, codes, langid, linededup, lm, mpegts, ngram_join, packing, quality, repair, secrets, spm, toxicity
from .common import fold, table

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BPE)


def op2_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op3_transport_streams(spark, sf_dir):
    return mpegts.read(mpegts.store(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, counts=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", "text")


def op7_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2)


def op8_sentencepiece(spark, sf_dir):
    return spm.digests(table(spark, sf_dir, "documents"), PIECES)


def op9_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)


def op11_vector_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark, sf_dir):
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_nearest_neighbours, op3_transport_streams, op4_secret_scan, op5_lm_scores, op6_line_dedup,
    op7_language_id, op8_sentencepiece, op9_ngram_join, op10_quality, op11_vector_codes, op12_conversation_repair, op13_toxicity)}
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": codes.sql()}

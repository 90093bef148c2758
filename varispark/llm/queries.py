"""The registered queries of this folder, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from varispark.llm import bit_planes, digests, importance, language_id, line_dedup, mixing, packing, secrets, simhash, token_counts, top_k, warc, whitening
from varispark.llm.oracles import ORACLE_SQL as ORACLE_SQL
from varispark.llm.shared import table
from varispark.llm.tokens import tokenizer_path

BYTE_BPE, WORD_BPE, END = "byte_bpe_50k.json", "word_bpe_49k.json", 2


def op1_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return token_counts.token_counts(docs, tokenizer_path(BYTE_BPE))


def op3_source_mixing(spark, sf_dir):
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    return language_id.identify(docs, language_id.fit(docs), ("doc_id", "held_out"))


def op5_bit_planes(spark, sf_dir):
    return bit_planes.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END)


def op6_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.clean(table(spark, sf_dir, "documents"), F.col("source")))


def op7_simhash(spark, sf_dir):
    return simhash.digest(simhash.groups(table(spark, sf_dir, "documents")))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), END)


def op9_top_k(spark, sf_dir):
    return top_k.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op10_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return digests.with_next(docs, digests.rarity(docs))


def op11_whitening(spark, sf_dir):
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark, sf_dir):
    return importance.digest(importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_warc(spark, sf_dir):
    return warc.digest(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_source_mixing, op4_language_id, op5_bit_planes, op6_line_dedup, op7_simhash, op8_packing, op9_top_k, op10_fingerprints, op11_whitening, op12_importance_resampling, op13_warc)}


"""Registered queries: each dealt operator over its whole table, and the pipeline, with SQL where SQL can express them."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from logfold.llm import bpe, language_id, sql
from logfold.llm.alignment import align_tokens
from logfold.llm.common import table
from logfold.llm.conversation_trie import prefix_trie
from logfold.llm.exact_dedup import exact_dedup
from logfold.llm.fingerprints import fingerprints
from logfold.llm.minhash_dedup import minhash_dedup
from logfold.llm.packing import best_fit
from logfold.llm.quality_classifier import classify
from logfold.llm.quality_rules import quality_rules
from logfold.llm.secret_scan import secret_digest
from logfold.llm.token_counts import token_counts
from logfold.llm.warc import warc_round_trip

VOCABULARY, OTHER_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"])


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.withColumn("held_out", language_id.held_out(F.col("doc_id")))


def op3_secret_scan(spark, sf_dir):
    return secret_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark, sf_dir):
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark, sf_dir):
    return minhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, carry=["doc_id"]).drop("clean_text")


def op7_bpe_round_trip(spark, sf_dir):
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op8_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY))


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark, sf_dir):
    return best_fit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op11_conversation_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align_tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(OTHER_VOCABULARY))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def op13_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fingerprints(docs, carry=["doc_id"])
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc": op4_warc,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_token_counts": op8_token_counts,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_fingerprints": op13_fingerprints,
    "pipeline": pipeline,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(sql.ORACLES)

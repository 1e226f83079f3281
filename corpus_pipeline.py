"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns documents
with their own columns; the last returns one row per packed piece. Stages are written as Parquet in between.
"""

from pyspark.sql import functions as F

from logfold.llm.common import shared_folder, table
from logfold.llm.exact_dedup import exact_dedup
from logfold.llm.minhash_dedup import minhash_dedup
from logfold.llm.packing import best_fit
from logfold.llm.quality_rules import quality_rules
from logfold.llm.secret_scan import redact


# Five-word sets that share this part of their union are near copies; op5 as a query has its own number.
NEAR_PERCENT = 80


def keep_good(spark, docs, sf_dir):
    """Documents that the quality rules do not reject, without the lines that they remove; ``n_chars`` follows the text."""
    rows = quality_rules(docs.selectExpr("struct(*) as _doc", "text"), carry=["_doc"]).filter("kept")
    clean = F.col("_doc").withField("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        clean = clean.withField("n_chars", F.char_length("clean_text").cast(docs.schema["n_chars"].dataType))
    return rows.select(clean.alias("_doc")).select("_doc.*")


def drop_copies(spark, docs, sf_dir):
    """One document of each group of exact copies."""
    return exact_dedup(docs.selectExpr("struct(*) as _doc", "doc_id", "text"), carry=["_doc"]).filter("kept").select("_doc.*")


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies."""
    rows = docs.selectExpr("struct(*) as _doc", "doc_id", "text")
    return minhash_dedup(rows, carry=["_doc"], percent=NEAR_PERCENT).filter("kept").select("_doc.*")


def mask_secrets(spark, docs, sf_dir):
    """All documents, with secrets in their texts replaced."""
    return redact(docs)


def pack(spark, docs, sf_dir):
    """Pieces of documents in sequences."""
    return best_fit(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

# Links by MinHash, masked texts and best-fit bins are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Documents to packed training sequences, in five stages.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and returns
the documents that it keeps, in the columns of ``documents``; the last one returns the
pieces of packed sequences.  Null, empty and repeated rows, and columns that are missing
or unknown, are handled as the operators state; an empty table passes through.

* language_id: rejects texts that are null or have no letter, and texts that no
  language claims (score below ``LEAST_SCORE``, of short texts ``LEAST_SCORE_SHORT``).
* near_dedup: of each class of near duplicates the document with the smallest id stays.
  Texts without words are in no class; of rows equal in id and text one stays.
* substring_dedup: texts lose the words of windows that started before.  Texts without
  such words stay as they are; a text that loses all words stays as an empty one.
* secret_scan: every secret is replaced by its kind in brackets.
* packing: sequences of 1024 ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.llm import dart_minhash, packing, secret_links, string_kernel, substring_dedup
from kymora.llm.common import stored

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
#: Least score of a text that a language claims: of all documents at sf0.1, the lowest under 64 code points is 0.13
#: ("A."), from there on 0.28 but for one of digits and signs (0.19).  Random letters score 0.07 to 0.16, whole
#: sentences of other languages 0.18 to 0.25.
LEAST_SCORE, LEAST_SCORE_SHORT, SHORT = 0.25, 0.12, 64


def shaped(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*[(docs[f"`{c}`"] if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = shaped(docs)
    model = string_kernel.fit(docs)
    named = string_kernel.predict(docs, model, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    languages = bool(model.languages)
    least = F.when(F.char_length("text") < SHORT, LEAST_SCORE_SHORT).otherwise(LEAST_SCORE)
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= least) if languages else F.col("text").rlike(r"\p{L}")
    return named.filter(kept).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = shaped(docs)
    first = dart_minhash.near_duplicates(docs).filter("first").select("doc_id", "node").distinct()
    key = [F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), F.coalesce("node", F.lit(b""))]
    named = docs.withColumn("node", F.unhex(F.md5("text")))
    keys = ["k_id", "k_null", "k_node"]
    kept = named.withColumns(dict(zip(keys, key, strict=True))).join(first.select(*[k.alias(n) for k, n in zip(key, keys, strict=True)]), keys, "left_semi")
    return kept.dropDuplicates(keys).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(shaped(docs), keep=("text", "lang", "source", "n_chars"))
    touched = F.col("n_removed") > 0
    text = F.when(touched, F.col("kept")).otherwise(F.col("text"))
    size = F.when(touched, F.char_length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_links.find_secrets(shaped(docs), keep=tuple(c for c in COLUMNS if c != "doc_id"), blank=True)
    size = F.when(F.size("spans") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(shaped(docs), public_tokenizers.path("byte_bpe_50k.json"))
    length = F.expr("cast(octet_length(ids) div 4 as bigint)")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", without_repeats), ("secret_scan", secret_scan), ("packing", packed)]
#: No SQL states a kernel classifier, signatures or byte-pair merges: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

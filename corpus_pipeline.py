"""The corpus pipeline: five of the operators in ``llm``, one after the other, over ``documents``.

``run`` writes each stage as Parquet and reads it back as the next one's input, so a lost executor costs a
stage at most.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, mixing, ngram_join, ordinal, token_store
from llm.common import materialize
from llm.queries import END_ID, MAX_REPEAT, SHARE, WEIGHTS, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go."""
    return ordinal.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest id.  Documents without words and rows without an id, which
    link with nothing, stay.  An id with several texts is several documents; of rows with the same id and text one stays."""
    named = docs.where("doc_id is not null").withColumns({"_key": F.xxhash64("doc_id", "text"), "_digest": F.md5("text")})
    ids = named.select("doc_id", "_digest", "_key").distinct()
    # documents told apart by id and 128 bits of the text; should different ones ever share a key of 64 bits, they all stay
    unclear = materialize(ids.groupBy("_key").count().where("count > 1").select("_key"))
    clear = named.join(unclear, "_key", "left_anti") if unclear.limit(1).count() else named
    groups = ngram_join.similar_components(clear.select("_key", "text"), doc_id="_key")
    linked = groups.where("n_shingles > 0").select("_key", "component_id").distinct()
    stays = linked.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_key"))
    gone = linked.select("_key").join(stays.select("_key"), "_key", "left_anti").join(ids, "_key").select("doc_id", "_digest")
    # both by id and digest, so texts are shuffled once
    kept = named.drop("_key").dropDuplicates(["doc_id", "_digest"]).join(gone, ["doc_id", "_digest"], "left_anti").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copied ranges are cut from the texts; documents of which they are more than half go.  ``n_chars`` follows the text."""
    cleaned = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.withColumns({"_size": mixing.word_count(F.col("text")), "_sources": F.array("source")})
    mixed, _ = mixing.mix(sized, size="_size", sources="_sources", doc_id="doc_id", weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT)
    return mixed.where("_copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The files of token ids, written and read back: doc_id, start, n_tokens, ids_crc32."""
    path = token_store.new_path(spark, "corpus-ids")
    token_store.write_tokens(docs, path, tokenizer_path(), end_id=END_ID)
    return token_store.read_tokens(spark, path)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", clean_of_benchmark),
    ("mix", mixture),
    ("token_ids", token_ids),
]
#: Models, seeded hashes and tokenizers are beyond SQL; tests/llm/test_queries.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = token_store.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

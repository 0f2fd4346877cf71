"""Corpus pipeline: documents in, token records out.

Each stage takes what its predecessor kept, reread from Parquet, and all but the last return the columns of
``documents``. The mixing stage writes its rows in mixed order; the last stage keeps that order by the files' names and
row numbers. Nulls, repeated rows, extra columns and empty tables are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.decontamination import contaminated
from shelfcast.llm.ngram_jaccard import ngram_components
from shelfcast.llm.pfair_mixing import mix_sources
from shelfcast.llm.queries import ship_package
from shelfcast.llm.site_quality import keep_good
from shelfcast.llm.token_records import TOKENIZER, read_token_records, write_token_records
from shelfcast.session import work_folder, written_table

ORACLE_SQL = None  # the stages learn models and write files; they are tested against brute-force versions


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that are more likely low quality than not go."""
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of linked documents the one with the smallest doc_id stays.

    Of different or equal rows with one doc_id one stays, that with the smallest hash of its columns. Rows without a
    doc_id are no document that could be linked and all stay.
    """
    ship_package(spark)
    copies = ngram_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    copies = written_table(copies)
    repeated = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_copy")).count().filter("count > 1").select("_copy")
    repeated = written_table(repeated.join(copies, "_copy", "left_anti"))
    kept = docs.join(copies.unionByName(repeated), docs["doc_id"] == F.col("_copy"), "left_anti")
    if repeated.isEmpty():
        return kept
    several = docs.join(repeated, docs["doc_id"] == F.col("_copy"), "left_semi")
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return kept.unionByName(one.select("_row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a passage of the benchmark go."""
    ship_package(spark)
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"] == found["_leak"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all documents, in the order of the schedule that mixes sources to their target weights."""
    return mix_sources(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: (doc_id, start, n_tokens, ids_crc32, shard) of the records, in the mixed order."""
    import public_tokenizers

    ship_package(spark)
    folder = work_folder(spark)
    order = None
    if docs.inputFiles():
        # Files are numbered in the order of the mixing stage's partitions (the number's digits may differ), rows in the
        # order within.
        name = F.col("_metadata.file_name")
        order = [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]
    manifest = write_token_records(docs, folder, public_tokenizers.path(TOKENIZER), order)
    return read_token_records(manifest, folder, keep_ids=False).drop("ids")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pfair_mixing", mixed),
    ("token_records", token_records),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs

"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Every stage reads all rows and whole texts. Null and empty texts have no words: no stage drops them. Rows that share a
doc_id are told apart by their text; equal rows count as often as they occur but in ngram_jaccard, where one of them
stays. An empty table gives no rows. All stages but the last return the columns of ``docs``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import fresh, materialise, table, text_column
from fathom.llm.jaccard import joined, numbers_apart, with_numbers
from fathom.llm.linededup import deduplicated
from fathom.llm.mixing import mixed
from fathom.llm.packing import pack
from fathom.llm.queries import tokenizer_path
from fathom.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected at their language's threshold, unchanged."""
    return clean(docs, table(spark, sf_dir, "labels"), sample=0)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks of lines; a text may become empty."""
    return deduplicated(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id, and all documents without words or doc_id.
    Rows that share a doc_id are documents of their own where their texts differ; of rows with one doc_id and text the
    first by their other columns stays."""
    numbers = numbers_apart(docs)
    (own,) = fresh(docs, "own_number")
    if numbers is None:
        marked = docs.withColumn(own, F.col("doc_id").cast("long"))
    else:
        marked = with_numbers(docs, materialise(numbers, "jaccard-numbers"), own)
    found = joined(marked.select(F.col(own).alias("doc_id"), "text"))
    keep = found.where((F.col("n_shingles") > 0) & (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("copies"))
    blank = ~text_column(docs).rlike("[^ \\t-\\r]") | F.col("doc_id").isNull()
    wanted, place = fresh(marked, "wanted", "place")
    kept = marked.where(~blank).join(keep.select(F.col("doc_id").alias(wanted)), F.col(own) == F.col(wanted), "left_semi")
    if keep.where("copies > 1").take(1):
        every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).cast("string")
        kept = kept.withColumn(place, F.row_number().over(Window.partitionBy(own).orderBy(every))).where(F.col(place) == 1).drop(place)
    return kept.drop(own).unionByName(docs.where(blank))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of mixing."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, in the order in which the stage before wrote them (numbers of files, rows).
    ``docs`` must be read from files; else the order is lost, which is an error."""
    read = docs.metadataColumn("_metadata")
    name = read["file_name"]
    number = F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long")
    ordered = docs.select(F.col("doc_id"), F.col("text"), number.alias("number"), name.alias("file"), read["row_index"].alias("row"))
    return pack(ordered, tokenizer_path("word_bpe_49k.json"), order_by=["number", "file", "row"])

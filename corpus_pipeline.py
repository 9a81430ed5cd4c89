"""The corpus pipeline: language ID, near-duplicate removal, passage removal, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents, and any further ones that docs has, whatever their names; the last returns the
pieces of packed sequences. An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.llm import jaccard_join, language, packing, suffix_dedup
from groupwise.llm.common import columns_as_row, discard, discard_inputs, materialise, row_as_columns
from groupwise.llm.tokens import default_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a determined language, however much of the text is in it.

    Null and empty texts and texts without a letter have none and go. Rows are judged one by one,
    whether ids or texts repeat or are null; if no row is labelled, no language is known and all go.
    """
    return language.determined(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, Jaccard >= 0.8) the smallest id.

    Where ids repeat or are null, rows are judged each by itself: of a group the row with the
    smallest id stays (null ids come last, then a hash of id and text decides), and of rows with
    one id and one text the one whose columns come first as JSON. Null texts and texts without words
    are in no group and all stay.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        classes = jaccard_join.classes(docs.select("doc_id", "text"), words=5, num=4, den=5)
        return jaccard_join.without(docs, classes.where("component_id <> doc_id").select("doc_id"))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), columns_as_row(docs).alias("row"))
    found = materialise(jaccard_join.classes(keyed.select("key", "text"), words=5, num=4, den=5, id_col="key").where("n_shingles > 0").toDF("key", "n_shingles", "component"), "rows")
    groups = found.select("key", "component").distinct()
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    least = groups.join(keyed.select("key", "doc_id").distinct(), "key").groupBy("component").agg(F.min_by("key", place).alias("least"))
    kept = keyed.join(groups.join(least, "component").where("key <> least").select("key"), "key", "left_anti")
    equal = found.groupBy("key").count().where("count > 1").select("key")
    one = kept.join(equal, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    rows = kept.join(equal, "key", "left_anti").select("row").unionByName(one.select("row"))
    return rows.select(*row_as_columns(docs.columns, "row"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a document with a smaller id has too, and sets n_chars.

    Rows of one id don't cut each other's passages, and rows with a null id neither cut nor are cut.
    Null texts stay null; a text that loses all is empty; texts shorter than 50 bytes stay as they are.
    """
    return suffix_dedup.remove(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens.

    Null and empty texts are their end id alone; rows are packed one by one, whether ids repeat or
    are null; of remainders of equal length the earlier row is placed first.
    """
    return packing.pack(docs, default_vocabulary(), end_id=1, capacity=2048)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", ngram_join), ("suffix-array dedup", passages), ("packing", pack)]
#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage reads goes when its table is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made, before = stage(spark, docs, sf_dir), docs
        docs = materialise(made, f"stage{k}")
        discard_inputs(made)
        discard(before)
    return docs

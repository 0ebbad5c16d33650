"""A training corpus from raw documents: five stages, each one of the corpus operators over all its predecessor kept.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents. Rows with null ids or texts and repeated rows are handled as the operators' docstrings say; empty tables
pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import language_id, line_dedup, near_dup, packing, pii
from tradelens.llm.common import NO_ID, place, row_key, saved, shielded, table
from tradelens.llm.queries import tokenizer_path

#: Words whose languages' mean marginal stays below this are a mixture that no language claims.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no language claims, go; with nothing to learn from, only the former.

    An empty table stays empty. Columns of docs may have any names besides doc_id, text and lang.
    """
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    own = shielded(docs)
    told = language_id.identify(own.withColumn("text", F.col(place(docs, "text"))), model, tuple(own.columns))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*own.columns).toDF(*docs.columns)


def counted(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as its text's length now."""
    if "n_chars" not in docs.columns:
        return docs
    n = place(docs, "n_chars")
    length = F.length(place(docs, "text")).cast(kinds.schema[docs.columns.index("n_chars")].dataType)
    return shielded(docs).withColumn(n, length).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more hold stay in the last of them; all documents stay.

    An empty table stays empty. Columns of docs may have any names besides doc_id, text and n_chars.
    """

    @F.pandas_udf("string")
    def kept(text, bitmap):
        import pandas as pd

        return pd.Series([t if m is None else "\n".join(line_dedup.kept_lines(t, m)) for t, m in zip(text, bitmap, strict=True)], dtype=object)

    out, text = shielded(line_dedup.with_bitmaps(docs)), place(docs, "text")
    bitmap = f"c{len(docs.columns)}"  # the column after those of docs
    return counted(out.withColumn(text, kept(F.col(text).cast("string"), bitmap)).drop(bitmap).toDF(*docs.columns), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, that of the smallest id.

    Null ids and ids that rows of other texts repeat don't make a group; only texts do. An empty table stays empty.
    Columns of docs may have any names besides doc_id and text.
    """
    found = near_dup.near_duplicates(docs, width=5, percent=80)
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "row"))
    keep = found.where("component is not null").groupBy("component").agg(least.alias("s")).select("s.*")

    own, text = shielded(docs), place(docs, "text")
    keyed = own.withColumn("doc_id", F.coalesce(F.col(place(docs, "doc_id")).cast("long"), F.lit(NO_ID))).withColumn("row", row_key(text))
    # Equal ids with equal texts are one node of a group; of such rows one stays.
    first = keyed.join(keep, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select(*own.columns)
    # Texts without a word are near-duplicates of nothing.
    blank = own.where(~F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return first.unionByName(blank).toDF(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind's name, words that give it away are generalised or removed; all documents stay.

    An empty table stays empty. Columns of docs may have any names besides doc_id, text and n_chars.
    """
    return counted(pii.sanitised(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token documents in sequences of 2048."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("packing", pack),
]

#: The learned language model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

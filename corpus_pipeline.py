"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
and read again before the next. All but the last return the columns of
``documents``, with n_chars counted anew where a text loses lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.line_rules import corpus_rules
from panelscope.llm.mixing import mix
from panelscope.llm.packing import pack
from panelscope.llm.partenum import one_of_each
from panelscope.llm.templates import drop_recurring
from panelscope.llm.words import WORD
from panelscope.sources.durable import durable


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``doc`` with the cleaned text."""
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go, and documents that fail the rules or are depleted.

    Null and empty texts fail. Repeated rows and equal texts count as one
    document of a line, and each is judged alike. Columns of any name pass
    through; an empty table gives an empty one.
    """
    return _with_text(corpus_rules(docs).filter("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first; documents without a word left go.

    Null and empty texts go. Of repeated rows and ties the first line by id
    stays, and rows that equal its own keep it too. Columns of any name pass
    through; an empty table gives an empty one.
    """
    return _with_text(drop_recurring(docs).filter(F.col("cleaned").rlike(WORD)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest id, of several texts with that id one, of repeated rows one.

    Null and empty texts are linked with nothing; each stays once per id. A null
    id is the last choice. Columns of any name pass through; an empty table
    gives an empty one.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows equal in all columns are one row that is taken as often as all of them
    together. A null source is a source of its own; null and empty texts add no
    words. Columns of any name pass through; an empty table gives an empty one.
    """
    row = F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    taken = mix(docs.select(row.alias("row"), "source", "text"), key="row").groupBy(F.col("doc_id").alias("row"))
    taken = taken.agg(F.sum("copies").alias("copies"), (F.count(F.lit(1)) > 1).alias("several")).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("doc"), row.alias("row")).join(taken, "row")
    once = rows.filter("not several").unionByName(rows.filter("several").dropDuplicates(["row"]))
    copied = once.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return copied.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence.

    A null or empty text is one piece with the end id alone. Repeated rows and
    ids are documents of their own; ties between lengths go by their order in
    the group. Other columns are ignored; an empty table gives no pieces.
    """
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Token ids and similarity on hashed sets have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs

"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and columns that bear
an operator's names: columns that operators do not read are held in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace
from lexilake.llm.decontaminate import contamination
from lexilake.llm.minhash import keep_one_of_each
from lexilake.llm.mixing import mix_sources
from lexilake.llm.tokens import token_output
from lexilake.llm.toxicity import learn, score


#: columns that operators read; the others are held in one, so that no operator's column can clash with them
READ = ("doc_id", "text", "source")


def _held(docs: DataFrame) -> DataFrame:
    return docs.select(*READ, F.struct(F.lit(1).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in READ)).alias("held"))


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs."""
    return out.select(*(F.col(c) if c in READ else F.col("held").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject.

    A null text is scored as the empty one. Repeated rows get one score and stay or go together; a null doc_id has no
    label. Without labels of both classes every document has the same score.
    """
    model = learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return _as_before(score(_held(docs), model).where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id, with all rows that bear it.

    Null and empty texts are near nothing and stay, as do rows without a doc_id.
    """
    return _as_before(keep_one_of_each(_held(docs)), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none; repeated rows go together."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _as_before(contamination(_held(docs), bench).where("not contaminated"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule: rows of the written files, in order of files, are mixed.

    A null source is a source of its own; null and empty texts fill no characters; repeated rows all stay. Rows of equal
    place stand by doc_id, nulls first.
    """
    mixed = mix_sources(_held(docs))
    order = ["mix_slot", "mix_place", "doc_id"]
    return _as_before(mixed.repartitionByRange(*order).sortWithinPartitions(*order), docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the order of the rows of docs' files (of doc_id for a table not read from files); one row a
    document, read back from the blocks. A null text has the end id alone; repeated rows are all written."""
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return token_output(docs)
    docs = docs.withColumn("_part", F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("long"))
    return token_output(docs, order=("_part", "_file", "_row"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: SQL can express neither the trained classifier nor a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        out = work.save(stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        before = docs = out
    return docs

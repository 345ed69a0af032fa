"""Training-data pipeline: documents that read well and aren't toxic, one of each group of near copies, packed into sequences.

Each stage works on all that the one before it kept. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard, packing, quality, toxicity
from folioscope.llm.common import ship, table, written


def plain(docs: DataFrame) -> DataFrame:
    """docs with names that clash with nothing: doc_id, text and lang stay, all others are numbered, so that no operator takes them for its own."""
    return docs.toDF(*(n if n in ("doc_id", "text", "lang") else f"c{k}" for k, n in enumerate(docs.columns)))


def read_well(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit. Null and empty texts go."""
    ship(spark)
    own = plain(docs)
    trusted = quality.trusted_of(own.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.judged(own, trusted).where("not rejected").select(*own.columns).toDF(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic by a model of the labelled ones among them."""
    ship(spark)
    own = plain(docs)
    model = toxicity.fit(own.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.scored(own, model).where("predicted = 0").select(*own.columns).toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies.

    Rows that share a doc_id are one document: the one of smallest text (null before any), then of smallest other columns, stays. Rows without a doc_id
    can't be told apart and stay. Columns that have no order (maps) don't decide.
    """
    ship(spark)
    own = plain(docs)
    kept = jaccard.joined(own.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    found = own.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    order = F.struct("text", *(f.name for f in own.schema.fields if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()))
    first = found.groupBy("doc_id").agg(F.min_by(F.struct(*own.columns), order).alias("row")).select("row.*")
    return first.unionByName(own.where("doc_id is null")).toDF(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 ids."""
    ship(spark)
    return packing.packed(docs)


STAGES = [("quality", read_well), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("packing", sequences)]

#: Trained models and tokenizers can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

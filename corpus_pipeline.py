"""From raw documents to encoded training text in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next one's docs.  All but the last return the columns of
``documents``.

1. quality: documents that the line classifier scores below its threshold go.
2. toxicity: documents that the clause grammar scores at its threshold or above go.
3. near_duplicates: of each component of near copies the document with the smallest id stays, whether
   or not other components hold that id; of several texts with that id the one of the smallest hash,
   and of several rows of that text the one whose JSON is smallest.  Documents with an id come before
   those without; of a component of only the latter one stays.  Rows without words are copies of nothing
   and all stay.
4. mixing: each row is repeated as often as the mix of its source takes it, perhaps not at all; the
   copies are sorted by their shard and shuffled inside it.
5. sentencepiece: each row's encoding: the ids, counts, a digest and the check that it decodes back.

Null, empty and very long texts pass every stage as the operators say; empty tables give empty tables.
Extra columns are carried along; names that clash with an operator's own are kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import jaccard_join, quality_crf, source_mixing, suffix_pieces, tables, toxicity_grammar


#: A column of our own beside the documents', whatever those are called.
HANDLE = "tidewater handle"


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_crf.fit(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels"), quality_crf.HELD_OUT)
    return tables.bounded(docs).mapInArrow(quality_crf.kept(model), _schema(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_grammar.fit(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels"), toxicity_grammar.HELD_OUT)
    return tables.bounded(docs).mapInArrow(toxicity_grammar.kept(model), _schema(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tables.importable(spark)
    docs = tables.bounded(docs)
    found = jaccard_join.near_duplicates(docs)
    rows = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "handle").alias("row")
    texts = found.where("label is not null").groupBy("label", rows).agg(F.count("*").alias("rows"))
    kept = texts.groupBy("label").agg(F.min(F.struct("row", "rows")).alias("x")).select("x.row.doc_id", "x.row.handle", "x.rows")
    bare = found.where("label is null").select("doc_id", "handle", F.lit(1).cast("long").alias("rows")).distinct()
    first = tables.stored(kept.unionByName(bare), "first")
    docs_by = docs.withColumn(HANDLE, F.xxhash64(F.col("text").cast("string")))

    def of(which: str) -> DataFrame:
        own = tables.narrow(first.where(which).select(F.col("doc_id").alias("own id"), F.col("handle").alias("own handle")))
        return docs_by.join(own, F.col("doc_id").eqNullSafe(F.col("own id")) & (F.col(HANDLE) == F.col("own handle")), "left_semi")

    once = of("rows = 1").select(*docs.columns)
    if first.where("rows > 1").isEmpty():
        return once
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = of("rows > 1").groupBy("doc_id", HANDLE).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return once.unionByName(repeated)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tables.importable(spark)
    return source_mixing.mixed_documents(tables.bounded(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tables.importable(spark)
    return suffix_pieces.encoded_digests(tables.bounded(docs), with_ids=True)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Learned models and merges are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored on its way goes when its result is there."""
    docs, began = tables.read(spark, sf_dir, "documents"), tables.written()
    for name, stage in STAGES[:-1]:
        docs = tables.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.release(spark, began)
    return STAGES[-1][1](spark, docs, sf_dir)

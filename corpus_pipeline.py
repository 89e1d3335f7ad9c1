"""A training corpus from raw documents: classified, deduplicated, masked, mixed and packed.

Every stage takes documents with any further columns and in any order, tells rows apart by all they
hold (never by doc_id alone), takes whole texts of any length, and gives an empty result of the same
columns for an empty table. What each does with nulls, ties and equal rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.llm import langid, mixing, ngram_join, packing, pii, quality_model
from weftspan.llm._shared import prepare, rested, table, written

#: Words of a shingle, and the percentage of shared shingles from which on documents are copies; op3's own query has others.
SHINGLE_WORDS, ALIKE_PERCENT = 5, 80


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of at least a half; a tie stays).

    Null and empty texts score what the model gives no words. Equal rows all stay or all go. Rows with a
    null doc_id are scored, and not learned from. Without labels nothing is rejected.
    """
    rested(spark)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), ~langid.held_out(3, 1))
    name = next(n for n in ("score", *(f"score{k}" for k in range(len(docs.columns) + 1))) if n not in docs.columns)
    return quality_model.score(docs, model, keep=docs.columns, name=name).where(F.col(name) >= 0.5).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, of each group that shingles link, and one of equal rows.

    Rows are told apart by a hash of all that they hold, so that texts under one doc_id, or under
    none, each count for themselves; a null doc_id comes after all others, and equal ids go by the hash.
    Null and empty texts link with nothing, so only equal rows of them fall together.
    """
    rested(spark)
    own = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps can't be compared
    key = next(n for n in ("key", *(f"key{k}" for k in range(len(docs.columns) + 1))) if n not in docs.columns)
    rows = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in own]))
    found = ngram_join.classes(rows.select(F.col(key).alias("doc_id"), "text"), SHINGLE_WORDS, ALIKE_PERCENT)
    # most rows link with nothing, and are not among the members
    linked = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("component_id").alias("component")))
    members = linked.unionByName(linked.select(F.col("component").alias(key), "component")).distinct()
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key))
    members = written(rows.select(key, "doc_id").join(members, key))
    first = members.groupBy("component").agg(F.min_by(key, place).alias(key)).select(key)
    lost = members.select(key).join(first, key, "left_anti").distinct()
    return rows.join(lost, key, "left_anti").dropDuplicates([key, *own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null and empty texts, other columns and all rows stay, equal ones too."""
    rested(spark)
    return pii.redact(docs, pii.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times.

    A null source is a source of its own; rows without words are taken as their odds say and add nothing;
    each of several equal rows counts for itself. A null doc_id draws by its text.
    """
    rested(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: pieces of documents with their sequence and place in it. A null or empty text is its end id alone; equal rows are packed each on their own."""
    rested(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classified),
    ("ngram_jaccard", deduplicated),
    ("personal_data", masked),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: The classifier and the personal-data model can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

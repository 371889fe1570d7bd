"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. A decision holds for an id together with its text (and, where these matter, source and language), so
rows that repeat an id with another text are judged by themselves. Null ids are never grouped with
anything and pass the filters; so do null and empty texts, except where a stage says otherwise. Tables may be
empty and may have more columns, but none whose name begins with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark.llm import decontaminate, mixing, near_dup, passage_dedup, quality
from ndspark.llm.common import Scratch, seal, sized, text_key

ID, TEXT = "doc_id", "text"
KEY = [ID, "h", "g"]


def _same(docs: DataFrame, keys: DataFrame, more: dict[str, str] | None = None) -> Column:
    """Whether a row of ``docs`` is the one that a row of ``keys`` (columns of KEY after an underscore) is about; more: further columns of ``docs`` by their names in ``keys``."""
    h, g = text_key(TEXT)
    same = docs[ID].eqNullSafe(keys[f"_{ID}"]) & (h == keys["_h"]) & (g == keys["_g"])
    for name, column in (more or {}).items():
        same &= docs[column].cast("string").eqNullSafe(keys[name])
    return same


def _keys(found: DataFrame, *more: str) -> DataFrame:
    return seal(found.select(*[F.col(c).alias(f"_{c}") for c in [*KEY, *more]]).distinct())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged by their shape like others, null ids stay."""
    verdicts = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keyed=True)
    gone = sized(_keys(verdicts.where(~F.col("accepted") & F.col(ID).isNotNull()), "site", "path"))
    return docs.join(gone, _same(docs, gone, {"_site": "source", "_path": "lang"}), "left_anti")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id; of rows that share that id, the least."""
    found = near_dup.near_duplicates(docs, keyed=True).where(F.col(ID).isNotNull() & F.col("group").isNotNull())
    gone = sized(_keys(found.where(~F.col("kept"))))
    rest = docs.join(gone, _same(docs, gone), "left_anti")
    kept = found.where("kept")
    many = seal(kept.groupBy("group").count().where("count > 1").select("group"))
    if many.isEmpty():
        return rest
    several = sized(_keys(kept.join(sized(many), "group"), "group"))
    one = rest.join(several, _same(rest, several)).groupBy("_group").agg(F.min(F.struct(*[rest[c] for c in rest.columns])).alias("_row")).select("_row.*")
    return rest.join(several, _same(rest, several), "left_anti").unionByName(one)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which nothing is left goes."""
    removals, _ = passage_dedup.repeated(docs)
    return passage_dedup.remove(docs, removals)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keyed=True))


#: What the last stage adds; columns of ``docs`` with these names are replaced.
ADDED = ["size", "source_size", "target", "copies", "taken"]


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, null ids too, with the number of copies and words taken of each; rows that are repeated get the same."""
    mixed = mixing.mix(docs, keyed=True).where("copies > 0")
    groups = [F.col(c).alias(f"_{c}") for c in [*KEY, "source"]]
    plan = seal(mixed.groupBy(*groups, "size", "source_size", "target").agg(F.max("copies").alias("copies")).withColumn("taken", F.col("copies") * F.col("size")))
    plan = sized(plan.withColumnsRenamed({c: f"_{c}" for c in ADDED if c != "source_size"} | {"source_size": "_source_size"}))
    rows = docs.join(plan, _same(docs, plan, {"_source": "source"}))
    return rows.select(*[docs[c] for c in docs.columns if c not in ADDED], *[F.col(f"_{c}").alias(c) for c in ADDED])


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("passages", passage_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Trained models and sketches have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir))
        return seal(STAGES[-1][1](spark, docs, sf_dir))

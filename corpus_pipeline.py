"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`.  Stages are joined by Parquet tables in the shared folder, so a lost
executor costs a stage at most.  Cases, in all stages: an empty table gives an empty one; columns
beside `doc_id` and `text` keep their names and values, whatever they are called (stage 5 puts
underscores before its own names instead); `n_chars`, if there, is counted anew where a text is
cut.  Null and empty texts have no letters and go in stage 1; a later stage that meets them
(cut to nothing in stage 3 or 4) keeps them, and stage 5 gives them rate 1.  A null doc_id
counts as the smallest id: of a group with such a row, that row stays.  Of repeated rows stage 2
leaves one.

1. language ID: documents whose language is not told (no letters, or a score below 0.5) go;
2. n-gram Jaccard join (5 words, similarity 0.8): one document of each group stays;
3. suffix-array dedup: bytes inside 200-byte strings that stand elsewhere too are cut
   (whole characters only), the documents stay;
4. benchmark decontamination: the words of test phrases are cut, the documents stay;
5. mixing: every document gets its token count, domain posteriors and rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.decontaminate import decontaminated
from tidewell.llm.jaccard import representatives
from tidewell.llm.langid import identified
from tidewell.llm.mixing import label_domains, mixed
from tidewell.llm.suffix_dedup import deduplicated
from tidewell.sources.store import drop, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs, n=5, num=80, den=100)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Classifiers and components have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, applied to the whole `documents` table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # nothing reads it any more
            drop(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

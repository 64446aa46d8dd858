"""A cleaning pipeline over ``documents``: each stage works on all that the one before kept.

Stages: language (texts that can't be identified go), toxicity (toxic texts go), SimHash near-duplicates (one
of each group stays), benchmark contamination (contaminated texts go), BPE (a row of digests per text left).
All but the last return the columns of ``documents``. Models are trained on a bounded sample of a stage's
own input; everything else covers all of it.

The language stage keeps every language that was learned, and rejects texts that no language's regression claims
(a score below one half): those of other languages and scripts, and some of a word or two. Every stage takes nulls in any column, empty and
very long texts, repeated rows, extra columns of any name and empty tables; repeated rows share one fate, but the
near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, decontaminate, language, simhash, toxicity
from corpusloom.llm.common import read_table, spread, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go, and those whose score is below one half. Without a labelled row, a letter decides."""
    return language.keep_identified(docs, language.train(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts from the chain's threshold on go; equal scores are judged alike. Null and empty texts stay, and without labels of both kinds all do."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose fingerprints link, also through others, the one of smallest id stays, of equal rows any. Null and empty texts are one group."""
    return simhash.keep_one_of_each(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a hit word and at least one in 20 hit go. Null and empty texts stay; rows of one id are judged by their texts."""
    return decontaminate.keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row left: its id, number of ids, and hashes of ids and decoded text. Null and empty texts have no ids."""
    return bpe.bpe_digests(docs, bpe.vocabulary_path())


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("contamination", contamination_stage),
    ("bpe", bpe_stage),
]
#: No SQL: the models and the fingerprints have none. tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written to the shared folder and read again."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

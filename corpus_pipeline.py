"""A corpus pipeline: classify, deduplicate, cut repeats, mix, pack.

Each stage works on all that the one before kept and returns the columns of
documents, whichever there are; the last returns the packed pieces.

Defined results. quality: a null text is judged as an empty one; without
labels of both classes every row stays; repeated rows are judged separately.
near_duplicates: null and wordless texts, and rows without an id, stay; rows
that share an id stay or go together. repeated_passages: all rows stay, a null
text stays null; of rows equal in id and text one keeps its text; rows without
an id come first, those that share one in the order of their text's hash.
mixing: wordless rows stay or go as their source's shortest documents do; rows
equal in id, source and size are taken as often as each other. packing: a null
or empty text is one piece, the end id. Texts may be of any length. An empty
table goes through all stages as one. Other columns are carried to the last
stage and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import common, op2_minhash, op4_packing, op8_mix, op9_suffix, op10_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    net = op10_quality.trained(docs, common.table(spark, sf_dir, "labels"))
    return op10_quality.passing(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return op2_minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occur earlier."""
    return op9_suffix.without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return op8_mix.repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return op4_packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]
#: The classifier, the sketches and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage was made from is dropped then."""
    docs = common.table(spark, sf_dir, "documents")
    since = common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        common.drop_since(since)
    return STAGES[-1][1](spark, docs, sf_dir)

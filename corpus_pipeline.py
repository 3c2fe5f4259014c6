"""A corpus pipeline of four stages: toxicity filter, near-duplicate filter, passage removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame with the columns of documents (the last one: packed pieces).  Columns that a
stage needs for itself get names that docs doesn't have, so extra columns of any name stay as
they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porelane.llm import jaccard, packing, phrases, toxicity
from porelane.llm.common import free, table, written
from porelane.llm.queries import tokenizer_path
from porelane.session import ship

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Each row is judged by its own text, repeated rows alike; a null or empty text scores as a
    window without words; rows with a null doc_id are judged but never learned from.
    """
    ship(spark)
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    score = free("score", docs.columns)
    return toxicity.scored(docs, net, score=score).where(F.col(score) < THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of smallest doc_id.

    Rows without words (null, empty or blank text) and rows with a null doc_id all stay; repeated
    rows are copies, of which one stays; rows of one doc_id are judged by their texts.
    """
    ship(spark)
    return jaccard.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in recurring passages go; a text that loses none stays as it is, white space included.

    No row goes: a text that loses all its words is empty.  Null and empty texts stay; repeated rows
    are each other's copies and lose what is long enough.  n_chars, if there, follows the text.
    """
    ship(spark)
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = phrases.substring_dedup(docs, prefix=prefix)
    kept, cut = F.col(f"{prefix}kept"), F.col(f"{prefix}n_removed") > 0
    new = {"text": kept, "n_chars": F.length(kept)}
    return found.select([F.when(cut, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in docs.schema])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 1024 tokens.

    A null or empty text is one piece of the end id alone; every row is packed, repeated ones each
    and those with a null doc_id too; extra columns are left out.
    """
    ship(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: no stage's result can be said in SQL; the tests hold each against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

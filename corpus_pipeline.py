"""Corpus pipeline: toxicity, language ID, line dedup, SimHash near-dedup, packing.

Each stage takes all rows that the one before kept. All but the last return the columns of documents, whatever their names. In every stage
repeated rows are judged alike, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import language_id, line_dedup, packing, simhash, toxicity
from waymark.llm.common import bound_batches, drop_since, fresh, mark, materialize, named, read_table

#: Documents of a lower language score go, where there are four languages; chance is one over the number of languages.
MIN_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5, by a model of the labelled rows that aren't held out. Null and empty texts hold no toxic passage and stay, as do null ids."""
    bound_batches(spark)
    score = toxicity.scorer(spark, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    (own,) = fresh(docs.columns, "score")
    return docs.select("*", score(F.col("text")).alias(own)).where(F.col(own) < 0.5).select(*map(named, docs.columns))


def score_floor(n_langs: int) -> float:
    """The least language score that stays: as many times chance for any number of languages, at most 1."""
    return min(1.0, MIN_LANGUAGE_SCORE * 4 / max(1, n_langs))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told: not those without a letter (so no null or empty text), nor of a score near chance. Of languages that tie the first by name counts."""
    bound_batches(spark)
    model = language_id.fit(docs)
    verdict = language_id.classifier(spark, model)
    (own,) = fresh(docs.columns, "verdict")
    told = docs.select("*", verdict(F.col("text")).alias(own))
    return told.where((F.col(own)["lang_pred"] != language_id.UNKNOWN) & (F.col(own)["score"] >= score_floor(len(model.langs)))).select(*map(named, docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that repeat an earlier one, n_chars as it is then; rows that lost lines and have no text left go.

    Null texts stay. Rows equal in id and text lose the same lines; null ids come last.
    """
    (own,) = fresh(docs.columns, "deduped")
    done = line_dedup.with_lines_deduped(docs, out=own)
    of = lambda part: F.col(own)[part]
    left = done.where((of("n_kept") == of("n_lines")) | (F.length(F.trim(of("text"))) > 0))
    return left.select(*[of("text").alias(c) if c == "text" else F.length(of("text")).cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: of the smallest id, null ids last; rows that share an id but not the text are told apart. Null and empty texts are one class."""
    bound_batches(spark)
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' tokens in sequences; a null text is the end id alone, a null id stays null."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL can't express the trained models or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written to the shared folder and read again by the next, and goes when that has written its own."""
    since, docs = mark(), read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_since(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

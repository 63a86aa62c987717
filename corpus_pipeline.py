"""A corpus pipeline of five stages, each one operator of ``quaystone.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

1. toxicity: rejects documents scored 0.3 or more.
2. near duplicates: keeps one document of each group (five words, 0.8).
3. decontamination: rejects documents of which a twentieth or more is benchmark text.
4. personal data: replaces spans in ``text`` and sets ``n_chars`` anew.
5. encoding: token ids, checked by decoding them.

Rows whose doc_id is null or can't be read as a number pass stage 2 (they are in
no group); rows that repeat a doc_id are one document there and go or stay
together.  Texts of any length are whole to every stage.  Documents whose
text is null or empty are kept by every stage.  Columns that are not those of
``documents`` pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import decontaminate as dec
from quaystone.llm import neardup, pieces, pii, toxicity
from quaystone.llm.shared import quoted, table, written


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda own, keep: toxicity.score(own, machine, keep), "predicted = 0")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs).filter("doc_id is not null")
    gone = found.groupBy(F.col("doc_id").alias("gone")).agg(F.max("kept").alias("any_kept")).filter("not any_kept").select("gone")
    return docs.join(gone, F.expr("try_cast(doc_id as bigint)") == gone["gone"], "left_anti")


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda own, keep: dec.decontaminate(own, table(spark, sf_dir, "benchmark"), keep), "not contaminated")


def _kept(docs: DataFrame, judge, condition: str) -> DataFrame:
    """The rows of ``docs`` for whose text an operator's result meets ``condition``; its columns under names that can't clash."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    own = docs.select(*[F.col(quoted(c)).alias(names.get(c, c)) for c in docs.columns])
    return judge(own, own.columns).filter(condition).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, ["doc_id"], digests=True, ids=True)


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("personal_data", _personal_data),
    ("sentencepiece", _encoding),
]

#: The models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

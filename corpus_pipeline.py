"""The corpus pipeline: five stages over documents, each written and read again by whoever drives them.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. `run` applies them one after another; between
two stages the rows are kept in the checkpoint folder, so that a lost executor
costs one stage at most.

Null and empty texts pass every stage. Rows that repeat an identifier and a
text are treated alike; the third stage leaves one of them. Columns beside
those of documents go; an empty table gives no rows. Rows with a null
identifier take part like any other, but in line dedup, which leaves them as
they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import decontaminate, jaccard, line_dedup, pieces, toxicity
from locusframe.llm.common import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS[:-1], F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.CUT or more go, null texts stay. The model learns from this stage's documents and the labels, held-out rows left out."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs.select(*COLUMNS), model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Superseded lines go; so do documents of which no other line is left. Texts without words stay."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    return _columns(out.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines"))))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, with five words and a similarity of 0.8, the row with the smallest doc_id stays; texts without words stay all."""
    return jaccard.keep_one(docs.select(*COLUMNS), words=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which they are more than half go. Texts without words stay."""
    benchmark = read(spark, sf_dir, "benchmark")
    return _columns(decontaminate.clean_rows(docs.select(*COLUMNS), benchmark))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, exact of every row left; a null text has no tokens."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("SentencePiece encoding", tokenize),
]

#: A trained model and token ids can't be had from SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs

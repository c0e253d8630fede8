"""Labelled rows from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut, held_out, id_text


def training_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most `bound` labelled rows that are not held out, chosen by hashes of their identifiers and texts.

    Rows with a null identifier or label are left out; an identifier with
    several labels counts with the largest, one with several rows with each, as
    far as the bound goes. The chosen identifiers are broadcast: `bound` rows of
    two numbers at most.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = [(r["doc_id"], int(r["y"] > 0)) for r in chosen.toLocalIterator()]
    small = docs.sparkSession.createDataFrame(rows, "doc_id long, y int")
    found = id_text(docs).join(F.broadcast(small), "doc_id").select("doc_id", "text", "y")
    if found.count() <= bound:  # reads identifiers only
        return cut(found)
    by = [F.xxhash64("doc_id"), F.xxhash64("text"), F.col("doc_id"), F.sha2("text", 256)]
    order = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(by)])
    keys = found.select(order.alias("k")).groupBy("k").count().orderBy("k").limit(bound)
    keys = keys.select("k.*", F.sum("count").over(Window.orderBy("k")).alias("upto"), "count")  # `bound` rows at most
    last = keys.where(F.col("upto") >= bound).orderBy("upto").first()
    end = F.struct(*[F.lit(last[f"c{i}"]).cast(t).alias(f"c{i}") for i, t in enumerate(("long", "long", "long", "string"))])
    whole = found.where(order < end)
    part = found.where(order == end).limit(bound - last["upto"] + last["count"])  # rows alike in all columns
    return cut(whole.unionByName(part))

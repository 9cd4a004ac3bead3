"""Documents as paragraph, sentence and word tables.

One row a paragraph, sentence or word; ``doc_id`` is the partition key of all
that follows.  Sentences are built inside a document's row (arrays), so that
no shuffle is needed to number them; only exploding multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def documents(docs: DataFrame) -> DataFrame:
    """Documents with a key and a text.

    Splitting texts costs far more than moving them: an input of fewer parts
    than the session has cores (a table of one small file) is spread first.
    A large table has parts enough and is read in place.
    """
    return spread(docs.where("doc_id is not null and text is not null"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows in as many parts as the session has cores, where there are fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows partitioned by key in as many parts as the session shuffles into, at least one a core.

    For little data that costs much to work on: parts that the planner would
    join for their size stay apart.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _exploded(rows: DataFrame, column: str, number: str, name: str) -> DataFrame:
    """One row an element, with its number.

    An inner explode makes the optimizer compute the array twice more below
    it, to leave empty ones out before; the outer one doesn't, and what it
    gives for empty arrays is left out after.
    """
    return rows.select("doc_id", F.posexplode_outer(column).alias(number, name)).where(F.col(number).isNotNull())


def _kept(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null")


def paragraph_table(docs: DataFrame) -> DataFrame:
    """(doc_id, para, p): paragraphs numbered from 0."""
    return _exploded(_kept(docs).select("doc_id", T.paragraphs(F.col("text")).alias("ps")), "ps", "para", "p")


def sentence_arrays(docs: DataFrame) -> DataFrame:
    """(doc_id, ss): the sentences (para, s) of each document in order.

    Headings are left out, unless a document has nothing else.
    """
    rows = _kept(docs).select("doc_id", T.paragraphs(F.col("text")).alias("ps"))
    rows = rows.withColumn("ps", F.transform("ps", lambda p, i: F.struct(i.alias("para"), p.alias("p"), T.is_heading(p).alias("h"))))
    rows = rows.withColumn("body", F.filter("ps", lambda x: ~x["h"]))
    rows = rows.withColumn("ps", F.when(F.size("body") > 0, F.col("body")).otherwise(F.col("ps")))
    return rows.select("doc_id", F.flatten(F.transform("ps", lambda x: F.transform(T.sentences(x["p"]), lambda s: F.struct(x["para"].alias("para"), s.alias("s"))))).alias("ss"))


def sentence_table(docs: DataFrame) -> DataFrame:
    """(doc_id, para, idx, s, w): sentences numbered from 0 over the document, with their folded words."""
    return _exploded(sentence_arrays(docs), "ss", "idx", "x").select("doc_id", F.col("x.para").alias("para"), "idx", F.col("x.s").alias("s")).withColumn("w", T.words(F.col("s")))


def word_arrays(docs: DataFrame) -> DataFrame:
    """(doc_id, w): all words of a document's sentences in order, (word, idx, para)."""
    rows = sentence_arrays(docs)
    return rows.select("doc_id", F.flatten(F.transform("ss", lambda x, i: F.transform(T.words(x["s"]), lambda w: F.struct(w.alias("word"), i.alias("idx"), x["para"].alias("para"))))).alias("w"))


def word_table(docs: DataFrame) -> DataFrame:
    """(doc_id, para, idx, word, pos): words numbered from 0 over the document."""
    return _exploded(word_arrays(docs), "w", "pos", "x").select("doc_id", "x.para", "x.idx", "x.word", "pos")

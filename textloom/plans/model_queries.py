"""Queries of models and of what needs Arrow UDFs; rows only, no SQL tells them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import arrow as A
from textloom.operators import ensemble as E
from textloom.operators import features as X
from textloom.operators import sentencetable as S
from textloom.plans.catalogue import query
from textloom.plans.metric_queries import scored
from textloom.session import materialize, table


def _docs(spark, sf_dir):
    return S.documents(table(spark, sf_dir, "documents"))


@query("q_compose_unicode", r"select doc_id, md5(nfc_normalize(text)) as composed, len(regexp_extract_all(text, '&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);'))::int as n_references from documents where doc_id is not null and text is not null")
def q_compose_unicode(spark, sf_dir):
    """Composed texts and how many character references they hold."""
    references = F.size(F.regexp_extract_all("text", F.lit("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    return _docs(spark, sf_dir).select("doc_id", F.md5(A.compose("text")).alias("composed"), references.alias("n_references"))


@query("q_normalize_unicode")
def q_normalize_unicode(spark, sf_dir):
    """References undone and characters composed; DuckDB undoes no references, so that no SQL tells it."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(A.normalize_unicode("text")).alias("composed"))


@query("q_mtld")
def q_mtld(spark, sf_dir):
    w = S.word_arrays(_docs(spark, sf_dir)).select("doc_id", F.transform("w", lambda x: x["word"]).alias("w"))
    return w.mapInArrow(A.mtld_rows, "doc_id long, voc_mtld double").select("doc_id", F.round("voc_mtld", 6).alias("voc_mtld"))


@query("q_compression")
def q_compression(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(A.compression_ratio("text"), 6).alias("rep_compression"))


@query("q_calibrators")
def q_calibrators(spark, sf_dir):
    return E.compare_calibrators(materialize(scored(spark, sf_dir).select("id", "y", "p"), "scored"), "id")


@query("q_ensemble_scores")
def q_ensemble_scores(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("label is not null")
    sty, bur, voc = X.stylometry(docs), X.burstiness(docs), X.vocabulary_core(docs)
    rows = docs.select("doc_id", F.col("label").alias("y"), F.coalesce(F.nullif(F.lower(F.trim("group_id")), F.lit("")), F.col("doc_id").cast("string")).alias("g"))
    rows = materialize(rows.join(sty, "doc_id").join(bur, "doc_id").join(voc, "doc_id"), "features")
    names = [c for c, t in rows.dtypes if t == "double"]
    family = lambda p: [c for c in names if c.startswith(p)]
    specs = {"stylometric": ("logistic", family("sty_")), "burstiness": ("logistic", family("bur_")), "vocabulary": ("logistic", ["word_length", "function_share", "mattr"]), "statistical": ("boosting", names)}
    held, _ = E.out_of_fold(rows, specs, "g", 2)
    held = materialize(held.select("doc_id", "y", *specs), "held")
    weights = E.stack(held, list(specs))
    return held.select("doc_id", "y", *[F.round(d, 6).alias(d) for d in specs], F.round(E.stacked(weights), 6).alias("p"))

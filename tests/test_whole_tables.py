"""Queries over whole tables, against hand-made ones."""

import hashlib
import html
import unicodedata

from textloom.functions import arrow as A
from textloom.operators import metrics as M
from textloom.plans import catalogue


def test_tasks_are_dealt_over_all_samples(spark, tmp_path):
    rows = [(f"i{k:02}", k // 4 % 2, ["legal", "web", None][k % 3]) for k in range(24)]
    spark.createDataFrame([*rows, (None, 0, "legal"), rows[0]], "id string, label int, domain string").write.parquet(f"{tmp_path}/samples.parquet")
    got = {r.id: r.task for r in catalogue.queries()["q_task_assignment"](spark, str(tmp_path)).collect()}
    tasks = ["continue", "paraphrase", "paraphrase_ai", "polish"]
    assert got == {i: tasks[k % 4] for k, (i, label, _) in enumerate(rows) if label == int(tasks[k % 4] == "paraphrase_ai")}


def test_entities_are_undone_over_all_documents(spark, tmp_path):
    texts = {1: "plain", 2: "AT&amp;T &eacute;t&eacute; &#8217; & x &nope;", 3: "été &lt;b&gt;"}
    spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.t for r in rows.select("doc_id", A.normalize_unicode("text").alias("t")).collect()}
    assert got == {k: unicodedata.normalize("NFC", html.unescape(t)) for k, t in texts.items()}
    got = {r.doc_id: r.composed for r in catalogue.queries()["q_normalize_unicode"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(unicodedata.normalize("NFC", html.unescape(t)).encode()).hexdigest() for k, t in texts.items()}


def test_bootstrap_draws_five_hundred(spark):
    rows = spark.createDataFrame([(f"g{i}", i % 2, (i * 37 % 50) / 50 + i % 2 * 0.2) for i in range(60)], "g string, y int, p double")
    assert M.bootstrap_auc(rows, "g").first().n_valid == 500


def test_quantiles_with_a_half_at_the_seventh_digit_are_rounded_as_in_sql(spark):
    import duckdb

    values = [(f"f{k}", 0, (k * 7919 + i * i * 104729 % 9999991) / 1e6) for k in range(60) for i in range(2 + k % 9 * 4)]
    got = {r.feature: r.quantiles for r in M.population_stats(spark.createDataFrame(values, "feature string, y int, value double")).collect()}
    con = duckdb.connect()
    con.sql("create table v (feature varchar, value double)")
    con.executemany("insert into v values (?, ?)", [(f, v) for f, _, v in values])
    want = con.sql(f"select feature, list_transform(quantile_cont(value, [{', '.join(str(i / 20) for i in range(21))}]), lambda v: round(v, 6)) from v group by 1 having count(*) >= 5").fetchall()
    assert got == dict(want)

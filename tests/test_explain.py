"""Contributions, factors, disagreement, inference; statistics of words and sentences against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import gramstats, wordstats
from textloom.functions import lexicons as L
from textloom.operators import corpus as C
from textloom.operators import ensemble as E
from textloom.operators import explain as X
from textloom.operators import features as FT
from textloom.operators import inference as I
from textloom.operators import windows as W


def test_disagreement_names_detectors(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.9, None), ("b", 0.1, 0.9, 0.5), ("c", None, None, None), ("d", 0.5, 0.5, 0.5)], "k string, x double, y double, z double")
    got = {r.k: (r.spread, r.range, r.most_ai, r.most_human, r.note) for r in X.disagreement(rows, "k", ["z", "y", "x"]).collect()}
    assert got == {"a": (0.0, 0.0, "x", "x", "agree"), "b": (pytest.approx(0.326599), 0.8, "y", "x", "disagree"), "d": (0.0, 0.0, "x", "x", "agree")}


def test_logit_change_is_against_the_base(spark):
    score = lambda c: 2 * c["x"] + c["y"] * c["y"]
    made = X.logit_change({"x": F.col("x"), "y": F.col("y")}, score, {"x": 1.0, "y": 3.0, "z": None})
    got = spark.createDataFrame([(4.0, 5.0)], "x double, y double").select(made.alias("c")).first().c
    assert [(r.feature, r.contribution) for r in got] == [("x", 6.0), ("y", 16.0), ("z", 0.0)]


def test_factors_and_summaries(spark):
    rows = [("a", f"sty_f{i}", "stylometric", 1.0, c, 50.0, "low" if i % 2 else "high") for i, c in enumerate([0.9, 0.8, 0.7, 0.6, 0.5, 0.04, -0.9, -0.8, -0.7])] + [("b", "pun_g", "punctuation", None, 0.5, None, None)]
    df = spark.createDataFrame(rows, "k string, feature string, family string, value double, contribution double, human_percentile double, direction string")
    found = X.factors(df, "k")
    assert sorted((r.side, r.rank, r.feature) for r in found.collect()) == [("toward_ai", i + 1, f"sty_f{i}") for i in range(4)] + [("toward_human", 1, "sty_f6"), ("toward_human", 2, "sty_f7")]
    assert {r.k: r.summary for r in X.summaries(found, df, "k").collect()} == {"a": f"Factors: higher f0; lower f1; higher f2; lower f3. {X.CAVEAT}", "b": f"{X.NO_SIGNAL} {X.CAVEAT}"}
    assert {(r.k, r.family): r.contribution for r in X.family_contributions(df, "k").collect()} == {("a", "stylometric"): pytest.approx(1.14), ("b", "punctuation"): 0.5}


def test_paragraphs_weigh_words(spark):
    df = spark.createDataFrame([(1, 0, 3, 0.5), (1, 0, 1, 0.9), (1, 1, 0, 0.7)], "doc_id long, para int, words int, p double")
    assert {r.para: (r.words, r.probability) for r in X.paragraph_probability(df).collect()} == {0: (4, 0.6), 1: (0, None)}


def _documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def _random_text(rng, n):
    words = [rng.choice(["the", "road", "house", "and", "snow", "of", "old", "hill", "river", "was"]) for _ in range(n)]
    out = []
    while words:
        k = rng.randint(3, 9)
        out.append(" ".join(words[:k]).capitalize() + ".")
        words = words[k:]
    cut = rng.randint(1, len(out))
    return " ".join(out[:cut]) + "\n\n" + " ".join(out[cut:])


def test_word_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [_random_text(rng, rng.choice([3, 30, 60, 130, 400])) for _ in range(25)] + ["", None, "One."]
    got = {r.doc_id: r for r in FT.vocabulary_base(_documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = [x.strip(".").lower() for x in (t or "").split()]
        if not w:
            assert i not in got
            continue
        r, n = got[i], len(w)
        k = min(50, n)
        assert r.n_words == n and r.mattr == pytest.approx(np.mean([len(set(w[j : j + k])) / k for j in range(n - k + 1)]))
        content = [x for x in w if x not in L.FUNCTION]
        assert r.n_content == len(content) and dict(zip(r.types, r.counts)) == {x: w.count(x) for x in set(w)}
        last, repeats = {}, 0
        for j, x in enumerate(content):
            repeats += x in last and j - last[x] <= 50
            last[x] = j
        assert r.near_repeats == repeats
        if n >= 120:
            at = [j for j in range(10, n + 1, 10)]
            assert r.heaps == pytest.approx(np.polyfit(np.log(at), [math.log(len(set(w[:j]))) for j in at], 1)[0])
        else:
            assert r.heaps is None


def test_sentence_vectors_equal_the_matrix(spark):
    rng = random.Random(3)
    texts = [_random_text(rng, rng.choice([20, 80, 200])) for _ in range(20)] + ["The of and. The of. And the of. Of the.", "", None]
    docs = _documents(spark, texts)
    got = {r.doc_id: r for r in W.centroids(docs).collect()}
    sents = {}
    for r in FT.S.sentence_table(docs).orderBy("doc_id", "idx").collect():
        sents.setdefault(r.doc_id, []).append((r.para, [x for x in r.w if x not in L.FUNCTION]))
    assert set(got) == set(sents)
    for i, ss in sents.items():
        vocabulary = sorted({x for _, w in ss for x in w}) or ["-"]
        u = np.array([[w.count(v) for v in vocabulary] for _, w in ss], float)
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        gram, n = u @ u.T, len(ss)
        if n >= 3:
            total = gram.mean()
            sims = gram.mean(axis=1) / math.sqrt(total) if total > 1e-12 else np.zeros(n)
            assert got[i].sem_centroid_mean == pytest.approx(sims.mean(), abs=2e-6) and got[i].sem_centroid_std == pytest.approx(sims.std(), abs=2e-5)
        if n >= 4:
            h = np.eye(n) - 1 / n
            e = np.clip(np.linalg.eigvalsh(h @ gram @ h), 0, None)
            if e.sum() > 1e-9:
                assert got[i].sem_compression == pytest.approx(e.max() / e.sum(), abs=1e-3)
            else:
                assert got[i].sem_compression is None


def test_stages_of_nothing():
    import pyarrow as pa

    words = pa.RecordBatch.from_pydict({"doc_id": pa.array([], pa.int64()), "w": pa.array([], pa.list_(pa.string()))})
    assert list(wordstats.vocabulary_rows()([words])) == []
    ss = pa.list_(pa.struct([("para", pa.int32()), ("w", pa.list_(pa.string()))]))
    assert list(gramstats.coherence_rows([pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "ss": pa.array([None, []], ss)})])) == []


def test_ranks_of_strata_equal_one_window(spark):
    from pyspark.sql.window import Window

    rng = random.Random(8)
    rows = spark.createDataFrame([(f"k{i}", rng.choice(["a", "b", None])) for i in range(500)], "k string, g string")
    order = F.md5(F.concat(F.lit("7"), F.col("k")))
    want = {(r.k, r.n) for r in rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(order, "k"))).collect()}
    got = C.hashed_rank(rows, ["g"], order, "k", "n", "total").collect()
    assert {(r.k, r.n) for r in got} == want and {(r.g, r.total) for r in got} == {(g, sum(1 for r in got if r.g == g)) for g in ("a", "b", None)}


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, "xyz"[i % 3], f"g{i}", rng.gauss(1.5 * (i % 2), 1), rng.gauss(0, 1), None if i % 7 == 0 else rng.gauss(0.5 * (i % 2), 1)) for i in range(240)]
    return spark.createDataFrame(rows, "id long, y int, domain string, g string, a double, b double, c double")


def test_committees_coverage_and_bundles(spark, fitted, tmp_path):
    specs = {"one": ("logistic", ["a", "b"]), "two": ("logistic", ["c"])}
    held, models = E.out_of_fold(fitted, specs, "g", 2)
    platts = {k: E.Platt.fit(held.select("y", F.col(k).alias("p"))) for k in specs}
    bounds = I.feature_bounds(fitted, ["a", "b", "c"], 0.1)
    rows = I.infer(fitted, specs, models, platts, bounds).collect()
    assert len(rows) == 240 and all(0 < r.one < 1 and 0 <= r.one_confidence <= 1 and r.one_coverage in (0.0, 0.5, 1.0) for r in rows)
    assert all(r.two_coverage == 1.0 for r in rows if r.c is None)
    I.save_bundle(f"{tmp_path}/b", models, {"version": 3}, spark)
    again, about = I.load_bundle(f"{tmp_path}/b", spark)
    assert about == {"version": 3}
    assert sorted(r.one for r in E.committee(fitted, again, "one").collect()) == pytest.approx(sorted(r.one for r in E.committee(fitted, models, "one").collect()))


def test_importance_and_left_out_domains(spark, fitted):
    out = {r.domain: (r.n, r.roc_auc) for r in I.leave_one_out(fitted, "domain", "logistic", ["a", "b"]).collect()}
    assert set(out) == {"x", "y", "z"} and all(n == 80 and auc > 0.75 for n, auc in out.values())
    rows = E.M.balanced_weights(fitted, [])
    model = E.estimator("logistic", ["a", "b"], 240).fit(rows)
    loss = {r.feature: r.loss for r in I.permutation_importance(model, rows, "id", "logistic", ["a", "b"]).collect()}
    assert loss["a"] > 0.2 > abs(loss["b"])
    mixed = I.permuted(fitted, "id", "a", per_bucket=50)
    assert sorted(r.a for r in mixed.collect()) == sorted(r.a for r in fitted.collect()) and mixed.count() == 240
    base = {r.feature: r.contribution for r in I.ablation(model, fitted.where("id = 1"), "id", "logistic", ["a", "b"], {"a": 0.0, "b": None}).collect()}
    assert set(base) == {"a"}


def test_shares_are_calibrated_monotonically(spark):
    rng = random.Random(9)
    rows = [(x, min(1.0, max(0.0, x * x + rng.gauss(0, 0.05)))) for x in (rng.random() for _ in range(300))]
    df = spark.createDataFrame([*rows, (None, 0.5), (0.5, None)], "share double, truth double")
    fit = E.Isotonic.of_shares(df, "share", "truth")
    got = [r.c for r in spark.range(101).select(fit.transform(F.col("id") / 100).alias("c")).collect()]
    assert got == sorted(got) and got[0] >= 0 and got[-1] <= 1 and abs(got[50] - 0.25) < 0.08


def test_features_are_computed_once_a_text(spark, tmp_path):
    path, asked = f"{tmp_path}/cache", []

    def compute(docs):
        asked.append(docs.count())
        return docs.select("doc_id", F.length("text").alias("n"))

    first = _documents(spark, ["ab", "abc", "ab", None])
    assert sorted((r.doc_id, r.n) for r in I.cached_features(spark, path, first, "doc_id", "text", "1", compute).collect()) == [(0, 2), (1, 3), (2, 2)]
    second = _documents(spark, ["abcd", "abc"])
    assert sorted((r.doc_id, r.n) for r in I.cached_features(spark, path, second, "doc_id", "text", "1", compute).collect()) == [(0, 4), (1, 3)]
    assert asked == [2, 1]


def test_dedup_report_counts_stages(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [("a", base, "train"), ("b", base, "test"), ("c", base + " more", "test"), ("d", "other words entirely in this one text", "calib"), ("e", None, "test")]
    df = spark.createDataFrame(rows, "id string, text string, split string")
    assert {r.split: (r.n, r.exact_removed, r.near_removed) for r in C.dedup_report(df, {"train": 0, "calib": 1, "test": 2}).collect()} == {"train": (1, 0, 0), "test": (2, 1, 1), "calib": (1, 0, 0)}


def test_percentiles_stand_on_quantiles_rounded_as_in_sql(spark):
    # the first quarter is 3.8407755, 3.840776 in SQL; rounded down, the second value would lie at 25
    human = [1.0, 3.840775, 3.840777, 5.0, 6.0, 7.0]
    rows = spark.createDataFrame(list(enumerate(human)), "doc_id int, pun_comma_rate double")
    got = X.attribution(rows, rows.selectExpr("doc_id", "0 as y"), "doc_id", {"pun_comma_rate": 0.05})
    assert {r.doc_id: r.human_percentile for r in got.collect()}[1] == 20


def test_detectors_are_fitted_on_their_own_columns(spark, monkeypatch):
    seen = []

    class Recorder:
        def __init__(self, columns):
            self.columns = columns

        def fit(self, rows):
            seen.append(set(rows.columns) - {"y", "w"} == set(self.columns))

    monkeypatch.setattr(E, "estimator", lambda kind, columns, n: Recorder(columns))
    monkeypatch.setattr(E, "scored_by", lambda model, rows, kind, name: rows.withColumn(name, F.lit(0.5)))
    rows = spark.createDataFrame([(i, i % 2, f"g{i}", 1.0, 2.0) for i in range(8)], "k int, y int, g string, a double, b double")
    held, models = E.out_of_fold(rows, {"one": ("logistic", ["a"]), "both": ("boosting", ["a", "b"])}, "g", 2)
    assert seen == [True] * 4 and held.count() == 8 and {k: len(v) for k, v in models.items()} == {"one": 2, "both": 2}

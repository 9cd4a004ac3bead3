import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import arrow as A
from textloom.functions import stats, text
from textloom.functions.stopwords import stopword_language
from textloom.functions.tokenarrays import TokenBatch, distinct_windows, masked_hashes, window_hashes
from textloom.operators import corpus as C
from textloom.operators import features as X
from textloom.operators import levels as V
from textloom.operators import metrics as M
from textloom.operators import sentencetable as S
from textloom.operators import similarity as I
from textloom.operators import windows as W
from textloom.operators.components import connected_components


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'array<double>' if isinstance(values[n], list) else 'string' if isinstance(values[n], (str, type(None))) else 'double'}" for n in names))
    return row.select(column.alias("v")).first().v


def test_fold_and_words(spark):
    assert one(spark, text.words(F.col("t")), t="Don't STOP, Ωστόσο!") == ["don't", "stop", "ωστοσο"]


def test_tail(spark):
    assert one(spark, text.trim_incomplete_tail(F.col("t")), t="Done here. Not finish") == "Done here."
    assert one(spark, text.trim_incomplete_tail(F.col("t")), t="nothing ends") == "nothing ends"


def test_hard_wrap_is_joined(spark):
    lines = "\n".join(["word " * 14 + "end"] * 3)
    assert "\n" not in one(spark, text.unwrap(F.col("t")), t=lines)


def test_strip_labels(spark):
    assert one(spark, text.strip_labels(F.col("t")), t="\nTitle: x\nBody: stays\n") == "Body: stays\n"


def test_entropy_and_burst(spark):
    assert one(spark, stats.entropy(F.col("c"), 4), c=[1.0, 1.0, 1.0, 1.0]) == pytest.approx(1)
    rows = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert rows.agg(stats.burst(F.col("x")).alias("b")).first().b == pytest.approx(-1)
    assert rows.limit(1).agg(stats.burst(F.col("x")).alias("b")).first().b is None


def test_js_divergence_of_equal_counts(spark):
    assert one(spark, stats.js_divergence(F.col("a"), F.col("a")), a=[1.0, 2.0]) == pytest.approx(0)


def test_stopwords():
    assert stopword_language("The cat and the dog were in the house")[0] == "en"
    assert stopword_language("Το σπίτι είναι μικρό")[0] == "el"
    assert stopword_language("")[0] is None


def test_tokens_equal_python(spark):
    import unicodedata

    texts = ["Ünï_cödé 12½ x²!", None, "", "a\0b", "日本 ΣΊΣΥΦΟΣ İx", "𝔘nicode"]
    batch = TokenBatch(texts)
    for i, t in enumerate(texts):
        words, now = [], ""
        for ch in (t or "").lower() + "\n":
            if unicodedata.category(ch)[0] in "LN":
                now += ch
            elif now:
                words.append(now)
                now = ""
        assert [batch.token(k) for k in range(batch.offsets[i], batch.offsets[i + 1])] == words


def test_windows_do_not_cross_texts():
    batch = TokenBatch(["a b c", "d e f", "a b c"])
    h, at = window_hashes(batch, 3)
    assert at.tolist() == [0, 1, 2] and h[0] == h[2] != h[1]
    h, at = masked_hashes(TokenBatch(["a x c", "a y c"]), (1, 0, 1))
    assert h[0] == h[1]
    h, offsets = distinct_windows(TokenBatch(["a a a a", ""]), 2)
    assert len(h) == 1 and offsets.tolist() == [0, 1, 1]


def test_same_token_has_one_hash_anywhere():
    batch = TokenBatch(["alpha beta alpha", "gamma " * 500 + "alpha"])
    assert len({int(batch.hashes[0]), int(batch.hashes[2]), int(batch.hashes[-1])}) == 1


def test_auc_with_ties_and_wilson(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.1)], "y int, p double").withColumn("g", F.lit("x"))
    assert M.ranking_metrics(rows, ["g"]).first().roc_auc == pytest.approx(0.875)
    low, high = M.wilson(F.lit(5), F.lit(100))
    r = spark.range(1).select(low.alias("a"), high.alias("b"), M.wilson(F.lit(0), F.lit(0))[0].alias("c")).first()
    assert r.a < 0.05 < r.b


def test_one_class_has_no_auc(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.9)], "y int, p double").withColumn("g", F.lit("x"))
    assert M.ranking_metrics(rows, ["g"]).first().roc_auc is None


def test_thresholds_take_the_last_run(spark):
    rows = spark.createDataFrame([(25, 0.66), (50, 0.79), (75, 0.85), (100, 0.80), (150, 0.95)], "len int, auc double").withColumn("ok", F.col("auc") >= 0.84).withColumn("g", F.lit(1))
    assert M.threshold_from_suffix(rows, ["g"], "len", "ok").first().least == 150


def test_bands_are_clipped(spark):
    rows = spark.createDataFrame([(0, 0.99), (1, 0.99)] * 5, "y int, p double")
    assert tuple(M.bands(rows).first()) == (0.9, 0.5)


def test_mtld_and_compression(spark):
    words = "the cat sat on the mat and looked at the dog".split() * 10
    row = spark.createDataFrame([(words, "ab" * 400), (["a"], "short")], "w array<string>, t string").select(A.mtld("w").alias("m"), A.compression_ratio("t").alias("c")).collect()
    assert 1 < row[0].m < 60 and row[0].c < 0.1 and row[1].m is None and row[1].c is None


def test_null_guards_lose_no_rows(spark):
    docs = spark.createDataFrame([(1, "One sentence only."), (2, ""), (3, "abc"), (4, None), (5, "First one. Second one.")], "doc_id long, text string")
    assert S.sentence_table(docs).where("doc_id in (2, 4)").count() == 0
    rows = {r.doc_id: r for r in X.burstiness(docs).collect()}
    assert rows[1].bur_sent_len_std is None and rows[5].bur_sent_len_std == 0
    assert {r.doc_id for r in X.repetition(docs).collect()} == {1, 2, 3, 5}


def test_window_edges_shift(spark):
    s = spark.createDataFrame([(1, i) for i in range(7)] + [(2, i) for i in range(3)], "doc_id long, idx int")
    got = {}
    for r in W.centred_windows(s).collect():
        got.setdefault((r.doc_id, r.centre), []).append(r.idx)
    assert all(sorted(got[1, c]) == [0, 1, 2, 3, 4] for c in (0, 1, 2)) and all(sorted(got[1, c]) == [2, 3, 4, 5, 6] for c in (4, 5, 6))
    assert all(sorted(got[2, c]) == [0, 1, 2] for c in range(3))


def test_planted_change(spark):
    s = [(1, i, ("short words here." if i < 12 else "a considerably, longer, sentence with, many more different words inside it, really."), []) for i in range(24)]
    df = spark.createDataFrame(s, "doc_id long, idx int, s string, w array<string>").withColumn("w", text.words(F.col("s")))
    best = max(W.boundary_statistic(df).collect(), key=lambda r: r.t)
    assert best.b == 12
    assert [r.b for r in W.change_points(df, shuffles=50).collect()] == [12]


def test_segment_gap_has_label_0(spark):
    spans = spark.createDataFrame([("a", 0, 5, 6), ("a", 1, 0, 4)], "id string, idx int, start int, end int")
    segs = spark.createDataFrame([("a", 0, 0, 5, 1), ("a", 1, 6, 9, 0)], "id string, pos int, seg_start int, seg_end int, seg_label int")
    assert {r.idx: r.seg_label for r in W.segment_labels(spans, segs).collect()} == {0: 0, 1: 1}


def test_greedy_match_is_one_to_one(spark):
    t = spark.createDataFrame([("a", 10), ("a", 11)], "id string, b int")
    f = spark.createDataFrame([("a", 9), ("a", 30), ("b", 1)], "id string, b int")
    rows = {r.id: tuple(r)[1:] for r in W.match_boundaries(t, f).collect()}
    assert rows == {"a": (2, 2, 1), "b": (0, 1, 0)}


def test_winnow_short_and_runs(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "a b c d e f g h i j k")], "id long, text string")
    prints = I.winnow(docs, "id").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in prints}[1] == 1 and {r.key for r in prints} == {1, 4}
    lib = spark.createDataFrame([(7, "x y a b c d e f g h i z")], "ref long, text string")
    pairs = spark.createDataFrame([(4, 7)], "key long, ref long")
    run = I.exact_runs(pairs, I.grams(docs, "id", 5), I.grams(lib, "ref", 5)).first()
    assert (run.start, run.ref_start, run.length) == (0, 2, 9)


def test_group_split_keeps_groups(spark):
    rows = spark.createDataFrame([(f"i{k}", f"g{k // 3}", "s") for k in range(60)], "id string, group_key string, stratum string")
    split = C.group_split(rows, 0.2, 0.1)
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"test": 4, "calib": 2, "train": 14}


def test_near_duplicate_of_train_is_found(spark):
    long = " ".join(f"word{i} follows" for i in range(60))
    rows = spark.createDataFrame([("a", "train", long), ("b", "test", long + " one more sentence."), ("c", "test", "something else entirely in this text here"), ("d", None, long), ("e", "calib", None)], "id string, split string, text string")
    assert [r.id for r in C.near_duplicates_of_train(rows).collect()] == ["b"]


def test_minhash_keeps_copies_and_equal_signatures(spark):
    base = [f"word{i}" for i in range(400)]
    texts = {1: base, 2: base, 3: [*base, "more"], 4: [f"other{i}" for i in range(60)]}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    assert {tuple(r) for r in C.minhash_candidates(docs).collect()} == {(1, 2, True), (1, 3, False)}
    sig = {r.key: r.sh for r in C.window_sets(docs, "doc_id", "text", 5, 64).collect()}
    assert sig[1] == sig[3]


def test_hybrid_segments_tile_the_text(spark, sf_dir):
    docs = S.documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for r in C.hybrids(docs, S.sentence_table(docs)).collect():
        ends = [s["end"] for s in r.segments]
        assert r.segments[0]["start"] == 0 and ends[-1] == len(r.text)
        assert all(a["end"] < b["start"] <= a["end"] + 2 for a, b in zip(r.segments[:-1], r.segments[1:]))


def test_transforms_are_deterministic(spark):
    docs = spark.createDataFrame([(1, "These are several longer words, however it is not random at all.")], "doc_id long, text string")
    a, b = (docs.select(C.typo_noise(F.col("text"), F.col("doc_id"), 0.5).alias("t")).first().t for _ in range(2))
    assert a == b != docs.first().text
    assert docs.select(C.casualize(F.col("text")).alias("t")).first().t.count("isn't") == 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 2)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_latest_and_insert(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "x")], "key string, at int, v string")
    assert {r.key: r.v for r in V.latest(rows, "key", "at").collect()} == {"k": "new", "m": "x"}
    got = V.insert_if_absent(rows.select("key", "v"), spark.createDataFrame([("k", "no"), ("n", "yes")], "key string, v string"), "key")
    assert got.where("key = 'n'").count() == 1 and got.where("v = 'no'").count() == 0


def test_agreement_and_levels(spark):
    r = spark.createDataFrame([([0.9, 0.9], [1.0, 0.0])], "p array<double>, w array<double>").select(V.agreement(F.col("p"), F.col("w")).alias("a")).first()
    assert r.a == pytest.approx(1)
    assert one(spark, V.length_reliability(F.col("n")), n=75.0) == pytest.approx(0.4)
    assert math.isclose(np.float64(1), 1)

"""Texts against the grams of a library, without a row a pair."""

import numpy as np
import pyarrow as pa

from textloom.functions import hashedgrams as H
from textloom.operators import features as X
from textloom.operators import postings as N
from textloom.operators import similarity as I


def _brute(a, refs, n=8):
    known = {tuple(r[i : i + n]) for r in refs for i in range(len(r) - n + 1)}
    return {p for i in range(len(a) - n + 1) if tuple(a[i : i + n]) in known for p in range(i, i + n)}


def test_coverage_takes_words_of_any_reference_once(spark):
    draw = np.random.default_rng(3)
    refs = [[f"w{x}" for x in draw.integers(0, 40, 30)] for _ in range(30)]
    texts = {}
    for k in range(40):
        parts = [refs[r][i : i + m] for r, i, m in zip(draw.integers(0, 30, 3), draw.integers(0, 20, 3), draw.integers(5, 14, 3))]
        texts[f"t{k}"] = [w for p in parts for w in [*p, f"x{draw.integers(0, 9)}"] * draw.integers(1, 3)]
    texts["short"], texts["none"] = ["w1"] * 3, []
    left = spark.createDataFrame(list(texts.items()), "key string, w array<string>")
    right = spark.createDataFrame([(f"r{k}", r) for k, r in enumerate(refs)], "key string, w array<string>")
    got = {r.key: r.covered for r in I.coverage(left, right).collect()}
    assert got == {k: round(len(_brute(w, refs)) / len(w), 6) for k, w in texts.items() if w}


def test_grams_of_a_batch_stay_within_their_texts():
    w = pa.array([["a", "b", "c"], None, ["b", "c"], [], ["c", "a", "b", "c"]])
    text, pos, h = H.hashed(w, 2)
    assert list(zip(text, pos)) == [(0, 0), (0, 1), (2, 0), (4, 0), (4, 1), (4, 2)]
    assert h[0] == h[4] and h[1] == h[2] == h[5] and len(set(h)) == 3


def test_runs_by_files_and_by_a_join_are_those_of_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(5)
    refs = {f"r{k}": [f"w{x}" for x in draw.integers(0, 9, 40)] for k in range(12)}
    texts = {f"t{k}": [w for r, i in zip(draw.integers(0, 12, 4), draw.integers(0, 20, 4)) for w in [*refs[f"r{r}"][i : i + 12], "x"]] for k in range(20)} | {"none": [], "short": ["w1"]}
    want = set()
    for k, a in texts.items():
        for r, b in refs.items():
            for i in range(len(a)):
                for j in range(len(b)):
                    n = next((m for m in range(min(len(a) - i, len(b) - j)) if a[i + m] != b[j + m]), min(len(a) - i, len(b) - j))
                    if n >= 8 and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                        want.add((k, r, i, j, n))
    left, right = (spark.createDataFrame(list(x.items()), "key string, w array<string>") for x in (texts, refs))
    assert sorted(map(tuple, I.exact_runs(left, right).collect())) == sorted(want)
    monkeypatch.setattr(N, "local_folder", lambda _: None)
    assert sorted(map(tuple, I.exact_runs(left, right).collect())) == sorted(want)


def test_islands_are_the_same_where_they_do_not_fit_a_word():
    draw = np.random.default_rng(7)
    rows = np.unique(draw.integers(0, 6, (400, 4)), axis=0)
    small = N._islands(*rows.T)
    wide = N._islands(rows[:, 0] << 40, rows[:, 1] << 40, rows[:, 2], rows[:, 3])
    assert [(a >> 40, b >> 40, *x) for a, b, *x in zip(*wide)] == list(zip(*small))


def test_parts_are_whole_texts(monkeypatch):
    monkeypatch.setattr(N, "MET", 5)
    text, count = np.array([0, 0, 1, 3, 3, 3, 4, 7]), np.array([2, 1, 2, 4, 4, 4, 1, 1])
    assert [text[s].tolist() for s in N.in_parts(text, count)] == [[0, 0, 1], [3, 3, 3], [4, 7]]
    assert list(N.in_parts(text[:0], count[:0])) == []


def test_candidates_by_files_and_by_a_join_are_those_of_brute_force(spark, monkeypatch):
    from collections import Counter
    from hashlib import md5

    def prints(w):
        h = [int(md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:15], 16) for i in range(len(w) - 4)]
        return {int(md5(" ".join(w).encode()).hexdigest()[:15], 16)} if 0 < len(w) < 5 else {min(h[i : i + 4]) for i in range(max(1, len(h) - 3))} if h else set()

    draw = np.random.default_rng(9)
    lines = [[f"w{x}" for x in draw.integers(0, 50, 9)] for _ in range(12)]
    refs = {k * 7 % 31: [w for i in draw.integers(0, 12, 4) for w in lines[i]] for k in range(30)} | {90: ["a", "b"], 91: ["a"] * 6}
    texts = {f"t{k}": [w for i in draw.integers(0, 12, 3) for w in [*lines[i], "x"]] for k in range(40)} | {"short": ["a", "b"], "six": ["a"] * 6, "none": []}
    want = []
    for k, w in texts.items():
        shared = Counter({r: len(prints(w) & prints(x)) for r, x in refs.items()})
        best = sorted((-n, r) for r, n in shared.items() if n)[:5]
        want += [(k, r, -n, i + 1) for i, (n, r) in enumerate(best)]
    left = spark.createDataFrame(list(texts.items()), "key string, w array<string>")
    right = spark.createDataFrame(list(refs.items()), "key long, w array<string>")
    assert sorted(map(tuple, I.candidates(left, right, 5).collect())) == sorted(want)
    monkeypatch.setattr(N, "local_folder", lambda _: None)
    assert sorted(map(tuple, I.candidates(left, right, 5).collect())) == sorted(want)


def test_words_are_taken_apart_once_for_surprisals(spark, monkeypatch):
    calls, table = [], X.S.word_table
    monkeypatch.setattr(X.S, "word_table", lambda docs: calls.append(1) or table(docs))
    X.surprisals(spark.createDataFrame([(1, "One two. Two three.")], "doc_id long, text string"))
    assert len(calls) == 1

"""What p2 keeps off the disk: texts of pairs that are too different, and pairs themselves."""

import random

import numpy as np
import pytest

from tests.llm.test_training_data import brute_pairs, random_rows
from textloom.llm import nearcopies, setjoin, textfiles

ROWS = "id string, text string"


def _docs(spark, rows, parts):
    df = spark.createDataFrame(rows, ROWS).repartition(parts)
    return df.selectExpr("xxhash64(text) as sig", "xxhash64('check', text) as check", "cast(3 as tinyint) as role", "text")


def test_texts_of_one_passage_are_told_apart_where_they_meet(spark):
    passage = " ".join(f"p{i}" for i in range(22))
    rows = [(f"t{k:02}", passage + "".join(f" w{k}x{i}" for i in range(18))) for k in range(60)]
    rows += [("u", rows[0][1] + " end"), ("v", rows[1][1])]
    spec = setjoin.JoinSpec(sketch_bits=17)
    assert setjoin.candidate_pairs(_docs(spark, rows, 3), spec).count() < 60 * 59 / 4  # all of them met: 60 * 59 / 2
    got = [tuple(r) for r in nearcopies.near_duplicate_pairs(spark.createDataFrame(rows, ROWS).repartition(3), spec=spec).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows) == {("t00", "u"), ("t01", "v")}


def test_entries_name_their_texts_in_few_bytes(spark):
    docs, spec = _docs(spark, random_rows(5, 400, (20, 60)), 2), setjoin.JoinSpec(sketch_bits=17)
    order = setjoin.corpus_order(docs, spec)
    shared = spark.sparkContext.broadcast(order.codes)
    lists = docs.mapInArrow(setjoin._list_stage(spec, 0, order.buckets, setjoin.standing_out(order, spec), shared, textfiles.new_folder(spark)), setjoin._LIST)
    row = lists.selectExpr("sum(length(rank)) as n", "sum(length(sizes) + length(roles)) as said", "sum(length(low)) as low").first()
    assert row.said == 0 and row.low == 4 * row.n


def test_pairs_are_not_shuffled_but_where_an_id_has_two_texts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    spec = setjoin.JoinSpec(sketch_bits=17)
    once = nearcopies.near_duplicate_pairs(spark.createDataFrame([("a", text), ("b", text), ("c", text + " x")], ROWS), spec=spec)
    assert not once._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    assert sorted(map(tuple, once.collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    twice = nearcopies.near_duplicate_pairs(spark.createDataFrame([("a", text), ("a", text + " x"), ("b", text), ("b", text)], ROWS), spec=spec)
    assert [tuple(r) for r in twice.collect()] == [("a", "b")]


@pytest.mark.parametrize("light", [0, 30])
def test_without_a_folder_of_the_file_system(spark, monkeypatch, light):
    monkeypatch.setattr(setjoin, "new_folder", lambda spark: None)
    monkeypatch.setattr(setjoin, "light_boundary", lambda *_: light)
    rows = random_rows(3, 90, (5, 60))
    got = nearcopies.near_duplicate_pairs(spark.createDataFrame(rows, ROWS).repartition(3), spec=setjoin.JoinSpec(sketch_bits=17, split=3, per_bucket=300)).collect()
    assert {tuple(r) for r in got} == brute_pairs(rows)


def test_parities_never_differ_by_more_than_the_sets(tmp_path):
    rng = random.Random(1)
    numbers = [rng.getrandbits(56) for _ in range(3000)]
    sets = [set(rng.sample(numbers[: k * rng.choice([1, 2, 9])], k)) for k in (1, 2, 31, 32, 33, 35, 60, 64, 65, 130, 300, 900, 1500, 2400)] + [set(numbers[:900]), set(numbers[:901])]
    key, text = (np.array(x) for x in zip(*[(w, i) for i, s in enumerate(sets) for w in sorted(s)]))
    key, size = key.astype(np.uint64), np.array([len(s) for s in sets])
    writer = textfiles.Writer(str(tmp_path))
    none = np.zeros(len(sets), np.int64)
    doc = writer.add(none + 7, none + 8, size, none.astype(np.uint8) + 3, textfiles.parities(key, text, size))
    writer.close()
    files = textfiles.Texts(str(tmp_path))
    assert [x.tolist() for x in files.about(doc)] == [[7] * len(sets), [8] * len(sets), size.tolist(), [3] * len(sets)]
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart, true = files.apart(doc, size, a, b), np.array([len(sets[i] ^ sets[j]) for i, j in zip(a, b)])
    assert (apart <= true).all() and (apart[a == b] == 0).all() and apart[-2] == 1 and (apart % 2 == true % 2).all()

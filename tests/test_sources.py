import json

import pytest

from textloom.sources import jsonrows as J
from textloom.sources import scans as R


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text", 1), ("b", None, None)], "id string, text string, label int")
    J.write_jsonl(rows, str(tmp_path / "x"))
    back = J.read_jsonl(spark, str(tmp_path / "x"))
    assert {(r.id, r.text, r.label) for r in back.collect()} == {("a", "text", 1), ("b", None, None)}


def test_broken_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{broken\n')
    assert J.read_jsonl(spark, str(tmp_path / "x.jsonl"), strict=False).select("id").count() == 1
    with pytest.raises(Exception):
        J.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()


def test_pairs_scan(spark, tmp_path):
    line = lambda **k: json.dumps(k) + "\n"
    (tmp_path / "essay_gen.jsonl").write_text(line(human_text="h1", machine_text="m1", prompt="p") + line(human_text="h1", machine_text="m2", prompt="p") + "{bad\n")
    (tmp_path / "review_gen-x.jsonl").write_text(line(human_reviews=["r1", "r2", "r3"], machine_reviews=["s1", "s2"]))
    rows = R.read_pairs(spark, str(tmp_path), 10, 10).collect()
    assert sorted((r.domain, r.generator, r.label, r.text) for r in rows) == [("essay", "gen", 1, "m1"), ("essay", "gen", 1, "m2"), ("essay", "none", 0, "h1"), ("review", "gen-x", 1, "s1"), ("review", "gen-x", 1, "s2"), ("review", "none", 0, "r1"), ("review", "none", 0, "r2")]


def test_text_tree_and_labels(spark, tmp_path):
    for k, t in (("1", "alpha text"), ("2", "beta text")):
        p = tmp_path / "essay" / "human" / f"{k}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(t)
    rows = R.read_text_tree(spark, str(tmp_path))
    assert sorted((r.domain, r.source, r.key, r.text) for r in rows.collect()) == [("essay", "human", "1", "alpha text"), ("essay", "human", "2", "beta text")]
    perturbed = spark.createDataFrame([("k", 0, "alpha text"), ("k", 5, "alpho text"), ("z", 0, "unknown")], "key string, level int, text string")
    originals = spark.createDataFrame([(1, "g", "alpha text")], "label int, group_key string, text string")
    assert sorted((r.key, r.level, r.label) for r in R.recover_labels(perturbed, originals).collect()) == [("k", 0, 1), ("k", 5, 1)]


def test_pack_paragraphs(spark):
    para = " ".join(["word"] * 10)
    rows = spark.createDataFrame([(1, "\n\n".join([para, "too short", para, para])), (2, None), (3, "")], "id long, text string")
    got = R.pack_paragraphs(rows, "id", least=20).collect()
    assert [(r.key, r.chunk) for r in got] == [(1, 0)] and "short" not in got[0].text


def test_decoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Καλημέρα".encode("cp1253"))
    (tmp_path / "b.md").write_bytes("Καλημέρα".encode())
    (tmp_path / "c.exe").write_bytes(b"MZ")
    rows = {r.path.rsplit("/", 1)[1]: r for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == rows["b.md"].text == "Καλημέρα" and rows["c.exe"].error


def test_nested_sets(spark, tmp_path):
    p = tmp_path / "SetA" / "x"
    p.mkdir(parents=True)
    (p.parent / "data.json").write_text(json.dumps([{"document": "one"}, {"document": " "}]))
    assert [(r.eval_set, r.text) for r in R.read_nested_sets(spark, str(tmp_path), {"SetA": "a"}).collect()] == [("a", "one")]


def test_settings_and_logs(spark, tmp_path):
    old = spark.createDataFrame([("a", "1")], "key string, value string")
    assert R.write_settings(old, spark.createDataFrame([("a", "2"), ("b", "3")], "key string, value string")).orderBy("key").collect()[0].value == "2"
    R.write_run_log(spark, {"run": 1, "auc": float("nan")}, str(tmp_path / "log"))
    assert R.read_run_logs(spark, str(tmp_path / "log")).count() == 1

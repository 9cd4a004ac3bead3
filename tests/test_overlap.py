"""Overlap with a library beyond the best few references."""

from textloom.operators import similarity as I
from textloom.plans import catalogue


def _write(spark, folder, passages, copies):
    """One sample of several passages; each passage in ``copies`` references."""
    texts = [" ".join(f"w{chr(97 + p)}{chr(97 + i)}" for i in range(10 + p)) for p in range(passages)]
    spark.createDataFrame([("s", " ".join(texts))], "id string, text string").write.parquet(f"{folder}/samples.parquet")
    refs = [(f"r{p:02}{c}", t) for p, t in enumerate(texts) for c in range(copies)]
    spark.createDataFrame(refs, "id string, text string").write.parquet(f"{folder}/reference_docs.parquet")
    return len(refs)


def test_runs_and_coverage_take_all_references(spark, tmp_path):
    n = _write(spark, tmp_path, 8, 1)
    queries = catalogue.queries()
    assert queries["q_exact_runs_all"](spark, str(tmp_path)).select("ref").distinct().count() == n
    assert queries["q_coverage_all"](spark, str(tmp_path)).first().covered == 1
    for name in ("q_containment_all", "q_tfidf_cosine_all"):
        assert queries[name](spark, str(tmp_path)).count() == n


def test_candidates_keep_twenty(spark, tmp_path):
    assert _write(spark, tmp_path, 8, 3) == 24
    assert catalogue.queries()["q_candidates_20"](spark, str(tmp_path)).count() == 20


def test_report_scores_all_before_its_top(spark):
    sample = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    better = sample[:28] + ["zza"] + sample[29:57]  # 56 words in two runs
    odd = [w for p in range(0, 100, 5) for w in [*sample[p : p + 5], f"x{chr(97 + p // 5)}y"]]  # many shared fives, no run of eight
    texts = spark.createDataFrame([("s", " ".join(sample))], "id string, text string")
    library = spark.createDataFrame([("good", " ".join(better))] + [(f"r{k:02}", " ".join(sample[50:76] + odd)) for k in range(12)], "ref string, text string")
    rows = {r.ref: r for r in I.similarity_report(texts, "id", library, "ref").collect()}
    assert len(rows) == 10 and rows["good"].words == 56 and rows["good"].longest == 28
    assert rows["good"].score == max(r.score for r in rows.values()) == 0.56

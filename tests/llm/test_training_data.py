"""The nine problems: against brute force, round trips and small fixtures; and hostile input."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.llm import crosssplit, cutoff, garbled, languages, leaks, mixture, nearcopies, pairdefects, queries, setjoin, splitplan

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same_rows):
    same_rows(queries.queries()[name], SQL[name])


def tokens(text):
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower()).split()


def brute_pairs(rows, width=5, threshold=0.5):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for i, w in ((i, tokens(t)) for i, t in rows if i is not None and t is not None)}
    text = {i: t for i, t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if text[a] == text[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))}


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, 5)):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], ["new"], [out[k], "more"], ["x", "y"]])
        out = out or ["left"]
    return out


def random_rows(seed, n, length):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(40)]
    for k in range(n):
        words = edited(rng, rows[rng.randrange(len(rows))][1].split()) if rows and rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(*length))]
        rows.append((f"id{k:03d}", " ".join(words)))
    return rows


@pytest.mark.parametrize(("light", "split", "length"), [(0, 4000, (4, 60)), (30, 4000, (4, 30)), (14, 2, (4, 40)), (0, 3, (10, 50)), (48, 2, (4, 12))])
def test_pairs_equal_brute_force(spark, monkeypatch, light, split, length):
    monkeypatch.setattr(setjoin, "light_boundary", lambda *_: light)
    rows = random_rows(light * 7 + split, 90, length)
    rows += [rows[3], ("copy", rows[5][1]), ("null", None), (None, "a b c d e f"), ("empty", ""), ("short", "a b")]
    spec = setjoin.JoinSpec(sketch_bits=17, split=split, per_bucket=300)
    got = nearcopies.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string").repartition(3), spec=spec)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs([*dict(r for r in rows if r[0]).items()])


def _entries(df, spec):
    order = setjoin.corpus_order(df, spec)
    lists = df.mapInArrow(setjoin._list_stage(spec, 0, order.buckets, setjoin.standing_out(order, spec), df.sparkSession.sparkContext.broadcast(order.codes)), setjoin._LIST)
    return order, lists.selectExpr("sum(length(rank)) as n").first().n


def test_a_full_sketch_replicates_nothing(spark):
    rows = random_rows(5, 400, (20, 60))
    df = spark.createDataFrame([(i, i, 3, t) for i, (_, t) in enumerate(rows)], "sig long, check long, role tinyint, text string").repartition(5)
    (full, most), (free, least) = (_entries(df, setjoin.JoinSpec(sketch_bits=b, split=5, per_bucket=300, fan_in=2)) for b in (3, 22))
    assert full.noise > 500 and free.noise < 1 and abs(most - least) <= 0.05 * least


def test_counts_are_merged_in_steps(spark):
    df = spark.createDataFrame([(1, t) for _, t in random_rows(6, 60, (20, 60))], "k long, text string").repartition(9)
    a, b = (setjoin.corpus_order(df, setjoin.JoinSpec(sketch_bits=17, fan_in=n)) for n in (2, 256))
    assert (a.codes == b.codes).all() and (a.light, a.buckets, a.noise) == (b.light, b.buckets, b.noise)


def test_windows_that_stand_out_are_spread(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "standing_out", lambda order, spec: __import__("numpy").where(2.0 ** (__import__("numpy").arange(256) / 8.0) - 1 > 8, 24.0, 0.0))
    rows = random_rows(12, 90, (5, 40))
    spec = setjoin.JoinSpec(sketch_bits=17, split=4, per_bucket=8)
    got = {tuple(r) for r in nearcopies.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string").repartition(3), spec=spec).collect()}
    assert got == brute_pairs(rows)


def test_hot_classes_are_packed(spark, monkeypatch):
    from textloom.llm import classpairs

    monkeypatch.setattr(classpairs.packed, "__defaults__", (4,))
    assert classpairs.packed.__defaults__ == (4,)
    text, near = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(31))
    rows = [(f"a{k:02}", text) for k in range(23)] + [(f"b{k:02}", near) for k in range(9)] + [("c", "other words stand here and nothing else is said")]
    got = [tuple(r) for r in nearcopies.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    df = spark.createDataFrame([(i, t, "train" if k % 3 else "test", None) for k, (i, t) in enumerate(rows)], "id string, text string, split string, eval_set string").withColumn("source_dataset", F.lit("s"))
    side = {i: k % 3 > 0 for k, (i, _) in enumerate(rows)}
    assert {tuple(r) for r in crosssplit.cross_split_pairs(df).collect()} == {(a, b) for a, b in brute_pairs(rows) if side[a] != side[b]}


def test_short_texts_overlap_only_as_they_are(spark):
    rows = [("a", "Yes, sir", "train"), ("b", "yes sir", "test"), ("c", "Yes, sir", "test"), ("d", "...", "train"), ("e", "...", "test"), ("f", "One, two three four five", "train"), ("g", "one two three four FIVE!", "test")]
    df = spark.createDataFrame(rows, "id string, text string, split string").withColumn("eval_set", F.lit(None).cast("string")).withColumn("source_dataset", F.lit("s"))
    assert {tuple(r) for r in crosssplit.cross_split_pairs(df).collect()} == {("a", "c"), ("d", "e"), ("f", "g")}


@pytest.mark.parametrize(("width", "threshold"), [(5, 0.8), (3, 0.3), (1, 0.6)])
def test_pairs_with_other_parameters(spark, width, threshold):
    rows = random_rows(99, 70, (6, 40))
    spec = setjoin.JoinSpec(width=width, threshold=threshold, sketch_bits=17)
    got = {tuple(r) for r in nearcopies.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), spec=spec).collect()}
    assert got == brute_pairs(rows, width, threshold)


def test_groups_follow_links(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("a", base), ("b", base + " end"), ("c", base), ("d", " ".join(f"z{i}" for i in range(50))), ("n", None)]
    got = {r.id: (r.group_id, r.n_copies, r.n_links) for r in nearcopies.near_duplicate_groups(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"a": ("a", 2, 1), "b": ("a", 1, 1), "c": ("a", 2, 1), "d": ("d", 1, 0)}


def test_cross_split_is_train_against_evaluation(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [("a", t, "train", None), ("b", t.upper() + "!", "test", None), ("c", t, "train", None), ("d", t, None, "held"), ("e", t, None, None), ("f", t + " x", "train", "held"), ("g", None, "test", None)]
    df = spark.createDataFrame(rows, "id string, text string, split string, eval_set string").withColumn("source_dataset", F.lit("s"))
    pairs = {tuple(r) for r in crosssplit.cross_split_pairs(df).collect()}
    assert pairs == {("a", "b"), ("b", "c"), ("a", "d"), ("c", "d"), ("a", "f"), ("c", "f")}
    report = {r.place: (r.n_records, r.n_exact, r.n_near_only, r.n_pairs) for r in crosssplit.cross_split_report(df).collect()}
    assert report == {"test": (1, 1, 0, 2), "held": (2, 1, 1, 4)}


ENDINGS = [
    ("It went well. The road was lo", "cut"), ("It went well. The road was [...]", "cut"), ("It went well. The road…", "cut"), ("All is said. …", "whole"), ("All is said.", "whole"), ("All \"is said.\"", "whole"),
    ("Πού είναι;", "whole"), ("they waited;", "cut"), ("It ended.\n- salt", "closing"), ("It ended.\n\nFigure 3: a road", "closing"), ("It ended.\n\nOldby, 3/4/2020", "closing"), ("It ended.\n(end of part one)", "closing"), ("It ended.\n\nCheers :)", "closing"),
    ("It ended.\nThe road", "cut"), ("It ended.\nKind regards,", "closing"), ("It ended.\n\nMit herzlichen Grüßen", "closing"), ("It ended.\n\nThanks to the may", "cut"), ("It ended.\n\nPart 2 of 5", "closing"), ("Schluss.\n\nAm Ende sind die 91", "cut"), ("Fin.\n\nLes 9", "cut"), ("It ended.\n\nThe end o", "cut"), ("Finì.\n\nSaluti", "closing"), ("Fin.\n\nUn abrazo", "closing"), ("Τέλος.\n\nΕυχαριστώ πολύ", "closing"), ("It ended.\n\nReferences", "closing"), ("It ended.\n\nNota", "cut"), ("It ended.\n\nLove and luc", "cut"), ("It ended.\n\nPublished in the vi", "cut"), ("-" * 900, "whole"), ("word " + "-" * 900, "cut"), (None, "whole"), ("", "whole"), ("...", "whole"), ("x" * 70, "cut"), ("Ende (mehr)", "cut"),
]


@pytest.mark.parametrize(("text", "state"), ENDINGS)
def test_endings(text, state):
    assert cutoff.ending(text)[0] == state


def _cuts(spark, rows):
    return {r.key: r.evidence for r in cutoff.cut_records(spark.createDataFrame(rows, "id string, text string")).collect()}


def test_verdicts_do_not_depend_on_other_rows(spark):
    rows = [("a", "It went.\n\nThanks in advance"), ("b", "It went well.\n\nQuite gre"), ("c", "Three.\n\nDi"), ("d", "Four.\n- salt"), ("e", "Five.\nPart 2 of 5"), ("f", "It went well. The road was [...]")]
    alone = {k: v for r in rows for k, v in _cuts(spark, [r]).items()}
    assert alone == {"b": "open", "c": "open", "f": "marked"}
    others = [("g", "Six.\n\nThanks in advance"), ("h", "Seven.\n\nQuite gre"), ("i", "One more.\nThanks in advance, all of you who came along with us today."), ("j", "Eight.\n\n- salt and pepper are what the kitchen always needs.")]
    assert {k: v for k, v in _cuts(spark, rows + others).items() if k in "abcdef"} == alone


def test_longer_copies_decide_closing_lines(spark):
    base = "The same long beginning stands here, and it ends well.\n\n"
    rows = [("a", base + "- salt"), ("b", base + "- salt and pepper"), ("c", base + "Part 2 of 5"), ("d", base + "Part 2 of 5\n\nMore text."), ("e", base + "Thanks"), ("f", base + "Thanks [...]"), ("g", base[:30]), ("h", "no " + base + "- salt")]
    assert _cuts(spark, rows) == {"a": "copy", "f": "marked", "g": "copy"}


def test_longer_copies_equal_brute_force(spark):
    rng = random.Random(5)
    whole = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 400))).strip() + "x" for _ in range(6)]
    rows = [(f"k{i}", w[: rng.randint(10, len(w))].strip()) for i, w in enumerate(rng.choice(whole) for _ in range(150))]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.key for r in cutoff.longer_copies(df, "id", "text", df.selectExpr("id as key", "0 as mark")).collect()}
    assert got == {i for i, t in rows if len(t) >= 16 and any(o.startswith(t) and len(o) > len(t) for _, o in rows)}


PAIRS = [
    ("continue", "Carry on in the manner of this text.\n\nThe road was quiet and the house on the hill was empty that day.", None, "empty"),
    ("continue", "p", "```\n```", "empty"), ("continue", "p", "(empty)", "empty"), ("polish", "p", "<text></text>", "empty"),
    ("continue", "p\n\nbody", "I'm sorry, but I can't help with that. Please try another text.", "refusal"),
    ("continue", "p\n\nbody", "Δυστυχώς πρέπει να αρνηθώ αυτό το αίτημα.", "refusal"),
    ("paraphrase", "Say it differently.\n\nThe road was quiet and the house on the hill was empty that day.", "THE ROAD was quiet, and the house on the hill was empty that day.", "copy"),
    ("polish", "Fix the grammar of the text below.\n\nThe road was quiet and the house on the hill was empty.", "The road was quiet and the house on the hill was empty.", None),
    ("polish", "Fix the grammar of the text below.\n\nThe road was quiet and the house on the hill was empty.", "Fix the grammar of the text below.\n\nThe road was quiet and the house on the hill was empty.", "copy"),
    ("translate_el", "Translate.\n\nThe road was quiet and the house on the hill was empty.", "La route était calme et la maison sur la colline était vide, dans le soir.", "wrong_language"),
    ("backtranslate", "Translate.\n\nΟ δρόμος ήταν ήσυχος και το σπίτι ήταν άδειο.", "The road was quiet and the house was empty.", None),
    (None, None, "The road was quiet and the house was empty.", None),
]


def test_defects(spark, sf_dir):
    spec = languages.LanguageSpec()
    scores = languages.WordScores(languages.fit_languages(spark.read.parquet(f"{sf_dir}/samples.parquet")), spec)
    task, prompt, text, want = zip(*PAIRS)
    assert pairdefects.defects(task, prompt, text, scores) == list(want)
    assert pairdefects.defects(task, prompt, text, None) == [None if w == "wrong_language" else w for w in want]
    assert pairdefects.defects([], [], [], scores) == []


STORY = "Il villaggio era quieto e la casa sulla collina era vuota. "
NO_REFUSALS = [
    "Non posso dire che fosse bello. " + STORY * 3, "Das kann ich nicht glauben, sagte er, und ging nach Hause.", "No puedo más, dijo ella.", "As an AI researcher she knew the answer.", "I'm not able to sleep when the wind blows.", "He said: I can't write this. " + "The road was quiet and the house on the hill was empty. " * 3,
    "Je ne peux pas oublier cette maison.", "Δεν μπορώ να κοιμηθώ απόψε.", "Non posso. Kann ich nicht. No puedo.",
]
ALL_REFUSALS = ["Leider kann ich diesen Text nicht übersetzen.", "Mi spiace, non posso tradurre questo brano.", "Sorry, I can’t help with that.", "Lo siento, no puedo continuar este relato.", "I must decline this request because of my guidelines. Please try something else."]


@pytest.mark.parametrize("text", NO_REFUSALS)
def test_words_of_refusals_in_answers(text):
    assert not pairdefects.is_refusal(text)


@pytest.mark.parametrize("text", ALL_REFUSALS)
def test_refusals_in_other_words(text):
    assert pairdefects.is_refusal(text) and pairdefects.defects(["continue"], ["p\n\nbody"], [text], None) == ["refusal"]


def test_containment_equals_sets():
    rng = random.Random(4)
    pairs = [(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for _ in range(80)]
    got = pairdefects._containment(pairdefects.TokenBatch([a for a, _ in pairs]), pairdefects.TokenBatch([b for _, b in pairs]))
    for (a, b), share in zip(pairs, got):
        x, y = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (a.split(), b.split()))
        assert share == (len(x & y) / len(x) if x else 1.0)


def test_remark_before_an_answer_is_no_refusal():
    assert not pairdefects.is_refusal("I'm unable to judge the source, so I kept to the wording.\n\n" + "The road was quiet and the house on the hill was empty that day. " * 4)


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert pairdefects.lcs_length(a, b) == t[-1][-1]


def _targets(spark, shares=(0.6, 0.2, 0.2)):
    return spark.createDataFrame([("p", s, x) for s, x in zip(("train", "calib", "test"), shares)], "plan_name string, split string, share double")


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    rows = [(f"i{k}", rng.choice([None, "", *(f"G{rng.randrange(300)}" for _ in range(9))]), rng.randint(0, 1), rng.choice(["x", "y", None])) for k in range(3000)]
    rows += [(f"h{k}", " Hot " if k % 2 else "hot", k % 2, "x") for k in range(900)] + rows[:50]
    df = spark.createDataFrame(rows, "id string, group_id string, label int, domain string")
    got = {r.id: r.split for r in splitplan.assign_splits(df, _targets(spark)).collect()}
    assert len(got) == 3900
    by = {}
    for i, g, *_ in rows:
        if g and g.strip():
            by.setdefault(g.strip().lower(), set()).add(got[i])
    assert all(len(s) == 1 for s in by.values())
    n = {s: sum(v == s for v in got.values()) / len(got) for s in ("train", "calib", "test")}
    assert all(abs(n[s] - x) < 0.01 for s, x in (("train", 0.6), ("calib", 0.2), ("test", 0.2)))
    again = {r.id: r.split for r in splitplan.assign_splits(df.repartition(7), _targets(spark)).collect()}
    assert again == got


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "id string, group_id string, label int, domain string")
    assert splitplan.assign_splits(df, _targets(spark)).count() == 0
    one = spark.createDataFrame([("a", None, None, None)], df.schema)
    assert splitplan.assign_splits(one, _targets(spark).where("false")).count() == 0
    assert splitplan.assign_splits(one, _targets(spark)).count() == 1


def test_splits_and_mixes_of_the_tables(spark, sf_dir):
    """Invariants on the tables: groups whole, shares met, no document beyond its repeats."""
    at = sf_dir.replace("sf0.001", "sf0.01")
    s = spark.read.parquet(f"{at}/samples.parquet").where("id is not null").select("id", F.lower(F.trim("group_id")).alias("g")).dropDuplicates(["id"])
    got = queries.queries()["p4_assignment"](spark, at)
    assert got.groupBy("plan_name", "id").count().where("count > 1").count() == 0
    joined = got.join(s, "id")
    assert joined.where("g <> ''").groupBy("plan_name", "g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    total = s.count()
    shares = {(r.plan_name, r.split): r["count"] / total for r in got.groupBy("plan_name", "split").count().collect()}
    for r in spark.read.parquet(f"{at}/split_targets.parquet").collect():
        assert abs(shares[r.plan_name, r.split] - r.share) < 0.01
    uses = queries.queries()["p8_uses"](spark, at).groupBy("mix_name", "source").agg(F.max("uses").alias("most"))
    goal = spark.read.parquet(f"{at}/mix_targets.parquet").select("mix_name", F.lower(F.trim("source")).alias("source"), "max_repeats")
    assert uses.count() > 0 and uses.join(goal, ["mix_name", "source"], "left").where("max_repeats is null or most > max_repeats").count() == 0


TEXTS = {
    "en": "The road to the village was closed because of the snow, and nobody knew when it would open again.",
    "el": "Ο δρόμος για το χωριό ήταν κλειστός λόγω του χιονιού και κανείς δεν ήξερε πότε θα άνοιγε ξανά.",
    "fr": "La route du village était fermée à cause de la neige et personne ne savait quand elle serait ouverte.",
    "de": "Die Straße zum Dorf war wegen des Schnees gesperrt, und niemand wusste, wann sie wieder offen sein würde.",
    "es": "El camino al pueblo estaba cerrado por la nieve y nadie sabía cuándo volvería a abrirse de nuevo.",
    "it": "La strada per il villaggio era chiusa per la neve e nessuno sapeva quando sarebbe stata riaperta.",
}


def test_languages_and_segments(spark):
    rows = [(f"{k}{n}", t, k) for k, t in TEXTS.items() for n in range(4)]
    rows += [("wrong", TEXTS["de"], "fr"), ("none", TEXTS["it"], None), ("spelt", TEXTS["fr"], "French"), ("mixed", TEXTS["en"] + " " + TEXTS["el"] + "\n\n" + TEXTS["en"], "en"), ("null", None, None), ("empty", "", "en"), ("place", TEXTS["el"] + "\n\nOldby, 3/9/2022", "el"), ("none", TEXTS["it"], None)]
    got = sorted(tuple(r) for r in languages.mislabelled_segments(spark.createDataFrame(rows, "id string, text string, language string")).collect())
    assert got == [("mixed", 1, "en"), ("mixed", 2, "el"), ("mixed", 3, "en"), ("none", 1, "it"), ("wrong", 1, "de")]


def test_languages_on_held_out_rows(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/samples.parquet")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as id", "text", "lang as language")
    d = d.where(~F.col("text").rlike("Ã|â€|Î|�"))
    told = languages.language_segments(d, matrix=languages.fit_languages(s)).where("code is not null and n_tokens >= 20").select("key", "code", "lang", "n_segments").where("n_segments = 1").collect()
    assert len(told) > 50 and sum(r.code == r.lang for r in told) / len(told) > 0.9


def test_leaks_tolerate_substitutions(spark):
    item = [f"t{i}" for i in range(40)]
    changed = [w if i % 14 != 13 else "zz" for i, w in enumerate(item)]
    short = [w if i % 7 != 6 else "zz" for i, w in enumerate(item)]
    docs = [(1, "pre " + " ".join(item[5:20]) + " post"), (2, " ".join(changed)), (3, " ".join(item[:11]) + " x"), (4, None), (5, ""), (6, " ".join(short)), (1, "pre " + " ".join(item[5:20]) + " post")]
    items = [(7, " ".join(item)), (8, "other words here"), (9, None), (10, " ".join(item))]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("eval_set", F.lit("s"))
    assert {tuple(r) for r in leaks.leaked_pairs(d, e).collect()} == {(x, y) for x in (1, 2) for y in (7, 10)}
    blocks = leaks.LeakSpec(block_chars=100)
    assert {tuple(r) for r in leaks.leaked_pairs(d, e, blocks).collect()} == {(x, y) for x in (1, 2) for y in (7, 10)}
    far = {(r.doc_id, r.item_id): (r.matched, r.substituted) for r in leaks.leaks(d, e).collect()}
    assert far[2, 7][1] == 2 and far[1, 7][0] == 15
    assert {r.item_id: r.n_documents for r in leaks.leaked_items(d, e).collect()} == {7: 2, 8: 0, 9: 0, 10: 2}


def brute_overlap(own, doc, mismatch=3):
    """(longest run, best score of an overlap with substitutions) over all diagonals."""
    run = best = 0
    for shift in range(-len(own) + 1, len(doc)):
        now = score = 0
        for k in range(max(0, -shift), min(len(own), len(doc) - shift)):
            same = own[k] == doc[k + shift]
            now = now + 1 if same else 0
            score = max(0, score + (1 if same else -mismatch))
            run, best = max(run, now), max(best, score)
    return run, best


def test_recall_of_substituted_passages(spark):
    rng = random.Random(11)
    items = [[f"v{rng.randrange(4000)}" for _ in range(60)] for _ in range(12)]
    docs = []
    for k in range(240):
        own = items[k % 12]
        a = rng.randrange(20)
        held = [w if rng.random() > rng.choice([0.03, 0.06, 0.1, 0.14]) else "changed" for w in own[a : a + rng.randint(15, 40)]]
        docs.append([f"x{rng.randrange(4000)}" for _ in range(10)] + held + [f"x{rng.randrange(4000)}" for _ in range(10)])
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").withColumn("eval_set", F.lit("s"))
    truth = {(i, j): brute_overlap(own, doc) for i, doc in enumerate(docs) for j, own in enumerate(items)}
    exact = {(r.doc_id, r.item_id) for r in leaks.leaked_pairs(d, e).collect()}
    assert exact == {k for k, (run, _) in truth.items() if run >= 12}
    changed = {(r.doc_id, r.item_id) for r in leaks.changed_pairs(d, e).collect()}
    want = {k for k, (run, best) in truth.items() if run < 12 and best >= 12}
    print("substituted passages found", len(changed & want), "of", len(want))
    assert changed <= want and len(changed) >= 0.9 * len(want) > 20


def test_sainte_lague():
    assert mixture.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert mixture.sainte_lague({"a": 0.9, "b": 0.1}, 10, {"a": 3, "b": 100}) == {"a": 3, "b": 7}
    assert mixture.sainte_lague({}, 3) == {} and mixture.sainte_lague({"a": 1.0}, 5, {"a": 0}) == {"a": 0}


def test_mix_reaches_shares_within_repeats(spark):
    docs = [(i, f"some words of document number {i} " * (1 + i % 3), "Big " if i % 5 else "small") for i in range(400)] + [(900, None, "big"), (901, "", "big"), (902, "text", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("m", "big", 0.5, 1, 0.6), ("m", "small", 0.5, 2, 0.6), ("m", "absent", 0.1, 2, 0.6)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    rows = mixture.mix_documents(d, t).collect()
    size = {s: sum(r.n_tokens * r.uses for r in rows if r.source == s) for s in ("big", "small")}
    assert max(r.uses for r in rows if r.source == "big") == 1 and max(r.uses for r in rows if r.source == "small") == 2
    assert abs(size["big"] / sum(size.values()) - 0.5) < 0.05
    report = {r.source: r for r in mixture.mix_report(d, t).collect()}
    assert report["absent"].tokens == 0 and report["big"].tokens == size["big"]


ORIGINALS = ["Östulmi’s café was “très” agréable — naïve señor, Größe.", "Έπρεπε να ελέγξει κανείς το μικρό γράμμα από την αρχή.", "Après l'été, où l’image reste légère à Noël.", "¡Qué lección tan útil para el otoño!"]


@pytest.mark.parametrize("text", ORIGINALS)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1253", "mac_roman", "cp437"])
def test_round_trip(text, wrong):
    bad = "".join(bytes([b]).decode(wrong) if _reads(b, wrong) else chr(b) for b in text.encode())
    assert garbled.repair(bad)[0] == text


def _reads(b, name):
    try:
        bytes([b]).decode(name)
        return True
    except UnicodeDecodeError:
        return False


def test_two_layers_and_parts():
    text = "The café’s menu. "
    once = text.encode().decode("cp1252")
    twice = once.encode().decode("cp1252")
    assert garbled.repair(twice)[0].strip() == text.strip()
    assert garbled.repair(text + once)[0] == text + text
    greek = ORIGINALS[1]
    assert garbled.repair(greek + " " + greek.encode("cp1253").decode("cp1252"))[0] == greek + " " + greek


RIGHT = ["São Belmiro e Conceição are two stops.", "In Łorvik the old spelling Ãlmer and Õrde is still seen.", "Great result 🎉 and a long walk home 🙂.", "£12.50 ± 5 % at 30 °C – a café price.", "GRÖSSE UND MAẞ", "ÂGE MOYEN ET CHÂTEAU FORT : UNE RÉPONSE À LA FÊTE.", "¿¡ÚLTIMA PÁGINA, AÑO Ñ!?", "They wrote Ωμέγα on the lid.", "page?item=7&view=full", "Mix ½ cup with 20 µg × 3.", "The tag © 2019 ™ was printed.", "Ωστόσο, το σπίτι."]


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_costs_nothing(text):
    assert garbled.garbling_cost(text) == 0


@pytest.mark.parametrize("text", ORIGINALS)
def test_references_are_the_outermost_layer(text):
    once = text.encode().decode("latin-1")
    assert garbled.repair("".join(c if c.isascii() else f"&#{ord(c)};" for c in once))[0] == text
    assert garbled.repair("".join(c if c.isascii() else f"&#x{ord(c):x};" for c in once))[0] == text
    assert garbled.repair("caf&Atilde;&copy;")[0] == "café"


LOSSES = [("También no es fácil.", "Tambi??n no es f??cil."), ("It’s “fair”, he said", "It???s ???fair,??? he said"), ("Der Größte", "Der Gr??te"), ("η αρχή του", "? ???? ???"), ("Conceição", "Concei??o"), ("Linadña balanced", "Linad?a balanced"), ("étudier", "??tudier")]
NO_LOSSES = ["And why?? Nobody knew.", "He asked why??", "The list at page?item=7&view=full is long.", "See https://x.org/a?b for it.", "Really?! Yes?", "Quoi ?? Il part.", "What???", "it&#8217;s AT&amp;T &eacute;t&eacute; &nbsp;&lt;b&gt;", "a & b; c"]


@pytest.mark.parametrize("text", [bad for _, bad in LOSSES])
def test_question_marks_for_letters_are_told(text):
    assert garbled.lost_characters(text)


@pytest.mark.parametrize("text", NO_LOSSES)
def test_question_marks_and_references_of_right_texts(text):
    assert not garbled.lost_characters(text) and not garbled.repair(text)[1]


def test_garbled_documents_without_other_than_ascii(spark):
    rows = [(1, "it&#226;&#8364;&#8482;s so"), (2, "Tambi??n no"), (3, "asked why??"), (4, "page?item=7&view=full"), (5, "it&#8217;s"), (6, "plain"), (7, "F&#195;&#188;hrung, c??te")]
    got = {r.doc_id: (r.restored, r.complete) for r in garbled.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("it’s so", True), 2: (None, False), 7: ("Führung, c??te", False)}


CLASH = ["key", "sig", "role", "h", "t", "n", "x", "y", "g", "m", "w", "c", "line", "level", "state", "text_a", "sig_a", "evidence", "defect", "bundle", "rank", "shard", "lang", "code", "data", "bucket", "full", "extra", "quota", "place"]


def hostile(spark, schema, rows):
    """Rows with nulls in every column, empty and very long texts, repeats, and columns with clashing names."""
    df = spark.createDataFrame(rows, schema)
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("empty", [False, True])
def test_hostile_tables(spark, empty):
    long = "Many words of one long text, and more. " * 40_000
    s = [("a", long, "en", "train", None, "g", 1, "d", 5, "src"), ("b", long, None, "test", None, "G ", None, None, None, None), (None, None, None, None, None, None, None, None, None, None), ("c", "", "", None, "e", "", 0, "d", 0, "src"), ("d", None, "en", "calib", None, None, 1, "d", 1, "src"), ("a", long, "en", "train", None, "g", 1, "d", 5, "src"), ("e", "​ \n\n", "en", "test", "e", "g", 1, "d", 1, "src")]
    schema = "id string, text string, language string, split string, eval_set string, group_id string, label int, domain string, n_words int, source_dataset string"
    s = hostile(spark, schema, [] if empty else s)
    d = hostile(spark, "doc_id long, text string, source string", [] if empty else [(1, long, "s"), (2, None, None), (None, "x", "s"), (3, "", "S "), (1, long, "s"), (4, "cafÃ© Ã " * 5000, "s")])
    e = hostile(spark, "item_id long, text string, eval_set string", [] if empty else [(1, long[:400], "v"), (2, None, None), (None, "x", "v"), (1, long[:400], "v")])
    g = hostile(spark, "gen_id long, task string, prompt string, text string, finish string, generator_family string", [] if empty else [(1, "polish", long, long, "stop", "f"), (2, None, None, None, None, None), (None, "polish", "p", "t", "stop", "f"), (3, "continue", "", "", None, "f"), (2, None, None, None, None, None)])
    t = _targets(spark)
    m = spark.createDataFrame([("m", "s", 1.0, 2, 0.5), ("m", None, None, None, None), (None, "s", 1.0, 1, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    spec = setjoin.JoinSpec(sketch_bits=17)
    got = {
        "p1": cutoff.cut_records(s), "p1r": cutoff.cut_rates(s), "p2": nearcopies.near_duplicate_pairs(s, spec=spec), "p2g": nearcopies.near_duplicate_groups(s, spec=spec), "p3": pairdefects.pair_defects(g, s), "p3r": pairdefects.defect_rates(g, s), "p4": splitplan.assign_splits(s, t), "p4r": splitplan.split_report(s, t),
        "p5": languages.mislabelled_segments(s), "p5d": languages.document_languages(s), "p6": crosssplit.cross_split_pairs(s, spec), "p6r": crosssplit.cross_split_report(s, spec), "p7": leaks.leaks(d, e), "p7i": leaks.leaked_items(d, e), "p7c": leaks.changed_pairs(d, e), "p8": mixture.mix_documents(d, m), "p8r": mixture.mix_report(d, m), "p9": garbled.garbled_documents(d),
    }
    got = {k: sorted(map(tuple, v.collect()), key=str) for k, v in got.items()}
    if empty:
        assert all(not v for k, v in got.items() if k != "p8r")
        return
    assert got["p2"] == [("a", "b")] and got["p6"] == [("a", "b")]
    assert [r[:2] for r in got["p2g"]] == [("a", "a"), ("b", "a"), ("c", "c"), ("e", "e")]
    assert {r[0]: r[1] for r in got["p3"]} == {1: "copy", 2: "empty", 3: "empty"} or {r[0] for r in got["p3"]} == {2, 3}
    assert sorted(r[1] for r in got["p4"]) == ["a", "b", "c", "d", "e"]
    assert ("b", 1, "en") in got["p5"] and not any(r[0] == "a" for r in got["p5"])
    assert [r[:2] for r in got["p7"]] == [(1, 1)] and [r[0] for r in got["p9"]] == [4]
    assert {r[1] for r in got["p8"]} <= {1, 4}


def test_found_columns(spark, sf_dir):
    want = {"p1_found": "id string", "p2_found": "id_a string, id_b string", "p3_found": "gen_id bigint, defect string", "p5_found": "id string, seg_no int, lang string", "p6_found": "id_a string, id_b string", "p7_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint"}
    for name, columns in want.items():
        df = queries.queries()[name](spark, sf_dir)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
        rows = df.collect()
        assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"textloom\.llm|from \.llm", p.read_text())


def test_many_diagonals_equal_one_by_one():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        own, doc = rng.integers(0, 3, rng.integers(12, 40)).astype(np.uint64), rng.integers(0, 3, rng.integers(12, 90)).astype(np.uint64)
        shifts = np.arange(-len(own) + 1, len(doc))
        longest, best = 0, (0, 0)
        for shift in shifts.tolist():
            s, e = max(0, -shift), min(len(own), len(doc) - shift)
            eq = own[s:e] == doc[s + shift : e + shift]
            longest = max(longest, leaks._longest_true(eq))
            matched, changed = leaks._best_overlap(eq, 3)
            best = max(best, (matched, -changed))
        assert leaks._overlaps(own, doc, shifts, 3) == (longest, best[0], -best[1])


def test_common_ends_are_taken_off():
    a = ["x"] * 60_000
    assert pairdefects.lcs_length(a, a) == 60_000 and pairdefects.lcs_length(a[:50] + ["y"] + a, a) == 60_000
    assert pairdefects.aligned(a, a[:-1] + ["z"]) and not pairdefects.aligned(["u", "v"] * 5000, ["w"] * 10_000)

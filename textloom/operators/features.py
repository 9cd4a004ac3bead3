"""Statistics of documents by family; undefined values are null.

What needs a document's words in order stays inside its row (``wordstats``);
what needs the corpus leaves it as counts of words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.functions import wordstats as W
from textloom.functions.stats import burst, chunk_of, cv, entropy, r6, std
from textloom.operators import sentencetable as S
from textloom.session import materialize

FLOOR = 1e-8


def word_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n, f): how often each word occurs in the corpus and its share."""
    n = S.word_table(docs).groupBy("word").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("word", "n", (F.col("n") / F.col("total")).alias("f"))  # one row


def surprisals(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, x, c): how often a sentence has a word of surprisal x.

    Words of a sentence are counted before the join on the word, which is
    what a frequent word costs there.
    """
    per = materialize(S.word_table(docs).groupBy("doc_id", "idx", "word").agg(F.count("*").alias("c")), "words")
    n = per.groupBy("word").agg(F.sum("c").alias("n"))
    freq = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("word", (-F.log2(F.greatest(F.col("n") / F.col("total"), F.lit(FLOOR)))).alias("x"))  # one row
    return materialize(per.join(freq, "word").select("doc_id", "idx", "x", "c"), "surprisals")


def predictability(docs: DataFrame) -> DataFrame:
    x = surprisals(docs)
    n = F.sum("c")
    q = lambda p: F.when(n >= 10, F.percentile("x", p, F.col("c")))
    mean = F.sum(F.col("x") * F.col("c")) / n
    tok = x.groupBy("doc_id").agg(r6(mean).alias("ppl_token_mean"), r6(F.percentile("x", 0.5, F.col("c"))).alias("ppl_token_median"), r6(q(0.9)).alias("ppl_token_q90"), r6(q(0.1)).alias("ppl_token_q10"), F.round(F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("x") * F.col("x") * F.col("c")) / n - mean * mean))), 5).alias("bur_ppl_token_std"))
    s = x.groupBy("doc_id", "idx").agg(F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m")).where("n >= 3")
    frame = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.currentRow, 2)
    s = s.withColumn("roll", F.when(F.count("*").over(frame) == 3, F.avg("m").over(frame)))
    m = F.col("m")
    sent = s.groupBy("doc_id").agg(
        r6(F.avg(m)).alias("ppl_sent_mean"), r6(F.percentile("m", 0.5)).alias("ppl_sent_median"), r6(F.min(m)).alias("ppl_sent_min"), r6(F.max(m)).alias("ppl_sent_max"),
        r6(std(m)).alias("bur_ppl_sent_std"), r6(cv(m)).alias("bur_ppl_sent_cv"), r6(burst(m)).alias("bur_ppl_sent_b"),
        r6(F.when(F.count(m) >= 3, F.percentile("m", 0.9) - F.percentile("m", 0.1))).alias("bur_ppl_sent_range"),
        r6(F.when(F.count(m) >= 4, F.stddev_pop("roll"))).alias("bur_ppl_rolling_std"),
    )
    return tok.join(sent, "doc_id", "left")


def burstiness(docs: DataFrame) -> DataFrame:
    s = S.sentence_table(docs).withColumn("n", F.size("w")).withColumn("len", F.when(F.col("n") > 0, F.col("n")))
    s = s.withColumn("ttr", F.when(F.col("n") >= 5, F.size(F.array_distinct("w")) / F.col("n")))
    x = F.col("len")
    return s.groupBy("doc_id").agg(r6(std(x)).alias("bur_sent_len_std"), r6(cv(x)).alias("bur_sent_len_cv"), r6(burst(x)).alias("bur_sent_len_b"), r6(std(F.col("ttr"))).alias("bur_vocab_std"))


LEXICONS = {"function": L.FUNCTION, "article": L.ARTICLES, "pron1s": L.PRON1S, "pron1p": L.PRON1P, "pron2": L.PRON2, "pron3": L.PRON3, "cconj": L.CCONJ, "sconj": L.SCONJ}


def stylometry(docs: DataFrame) -> DataFrame:
    s = S.sentence_table(docs).withColumn("n", F.size("w")).withColumn("end", T.end_mark(F.col("s")))
    lens = F.transform("w", lambda x: F.length(x))
    s = s.withColumns({"l1": F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x), "l2": F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x * x), "l7": F.size(F.filter(lens, lambda x: x >= 7)), "apos": F.size(F.filter("w", lambda x: x.contains("'")))})
    s = s.withColumns({f"x_{k}": T.lexicon_count(F.col("w"), v) for k, v in LEXICONS.items()})
    n = F.greatest(F.sum("n"), F.lit(1))
    mean = F.sum("l1") / n
    return s.groupBy("doc_id").agg(
        r6(F.avg("n")).alias("sty_sent_len_mean"), r6(F.percentile("n", 0.5)).alias("sty_sent_len_median"),
        r6(F.when(F.count("*") >= 3, F.percentile("n", 0.1))).alias("sty_sent_len_p10"), r6(F.when(F.count("*") >= 3, F.percentile("n", 0.9))).alias("sty_sent_len_p90"),
        r6(F.avg((F.col("n") < 8).cast("double"))).alias("sty_short_sent_frac"), r6(F.avg((F.col("n") > 30).cast("double"))).alias("sty_long_sent_frac"),
        r6(mean).alias("sty_word_len_mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum("l2") / n - mean * mean)), 5).alias("sty_word_len_std"), r6(F.sum("l7") / n).alias("sty_long_word_frac"),
        r6(100 * F.sum("apos") / n).alias("sty_contraction_rate"),
        r6(F.avg((F.col("end") == "question").cast("double"))).alias("sty_question_frac"), r6(F.avg((F.col("end") == "exclaim").cast("double"))).alias("sty_exclaim_frac"),
        *[r6(F.sum(f"x_{k}") / n).alias(f"sty_{k}_frac") for k in LEXICONS],
    )


#: Punctuation types: regular expression of one occurrence.
PUNCTUATION = {"comma": ",", "semicolon": ";", "colon": ":", "dash": "[—–]", "paren": r"[()]", "quote": "[\"“”«»]", "ellipsis": r"…|\.\.\.", "hyphen": r"\p{L}-\p{L}", "question": r"\?", "exclaim": "!"}
_PUNCT_CLASS = "([,;:—–()\"“”«»…?!.])"


def punctuation(docs: DataFrame) -> DataFrame:
    s = S.sentence_table(docs).withColumns({f"x_{k}": F.size(F.regexp_extract_all("s", F.lit(p), F.lit(0))) for k, p in PUNCTUATION.items()})
    s = s.withColumn("n", F.size("w")).withColumn("end", T.end_mark(F.col("s")))
    n = F.greatest(F.sum("n"), F.lit(1))
    ends = F.array(*[F.count_if(F.col("end") == e).cast("double") for e in ("period", "question", "exclaim", "ellipsis", "none")])
    types = F.array(*[F.sum(f"x_{k}").cast("double") for k in PUNCTUATION])
    base = s.groupBy("doc_id").agg(
        *[r6(100 * F.sum(f"x_{k}") / n).alias(f"pun_{k}_rate") for k in PUNCTUATION],
        r6(100 * reduce(lambda a, b: a + b, [F.sum(f"x_{k}") for k in PUNCTUATION]) / n).alias("pun_total_rate"),
        r6(std(F.col("x_comma"))).alias("pun_comma_per_sent_std"), r6(F.avg((F.col("end") == "none").cast("double"))).alias("pun_no_end_frac"),
        types.alias("types"), ends.alias("ends"), F.count("*").alias("ns"),
    )
    # pairs of neighbouring marks over the document
    marks = S.sentence_arrays(docs).select("doc_id", F.expr("flatten(transform(ss, x -> regexp_extract_all(x.s, '([,;:—–()\"“”«»…?!.])', 1)))").alias("m"))
    made = F.when(F.size("m") >= 4, F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.concat(F.element_at("m", i), F.element_at("m", i + 1))))
    pairs = marks.select("doc_id", F.explode_outer(made).alias("p")).where("p is not null")
    bigram = pairs.groupBy("doc_id", "p").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.collect_list(F.col("c").cast("double")).alias("cs"))  # at most 15 * 15 kinds
    bigram = bigram.select("doc_id", r6(entropy(F.array_sort("cs"), 100)).alias("pun_transition_entropy"))
    out = base.withColumn("pun_type_entropy", r6(entropy(F.col("types"), 10))).withColumn("pun_end_entropy", F.when(F.col("ns") >= 2, r6(entropy(F.col("ends"), 5)))).drop("types", "ends", "ns")
    return out.join(bigram, "doc_id", "left")


def vocabulary_base(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row a document with words: its counts and moving statistics, and its types with their counts; see ``wordstats``."""
    words = S.word_arrays(docs).select("doc_id", F.transform("w", lambda x: x["word"]).alias("w"))
    return words.mapInArrow(W.vocabulary_rows(window), W.ROWS)


def vocabulary(docs: DataFrame, window: int = 50) -> DataFrame:
    """Lexical diversity and density of each document with words.

    Only the types of a document leave its row, with their counts, to meet the
    corpus's frequencies.
    """
    base = materialize(vocabulary_base(docs, window), "vocabulary")
    types = base.select("doc_id", F.inline(F.arrays_zip("types", "counts", "content"))).select("doc_id", F.col("types").alias("word"), F.col("counts").alias("c"), "content")
    n = types.groupBy("word").agg(F.sum("c").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    freq = n.crossJoin(F.broadcast(total)).select("word", "n", (F.log10(F.col("n") / F.col("total")) + 9).alias("z"))  # one row
    m = F.sum("c")
    zm = F.sum(F.col("z") * F.col("c")) / m
    # there is no list of known words: unknown are those that no other document has
    dense = types.where("content").join(freq, "word").groupBy("doc_id").agg(r6(F.sum(F.when(F.col("n") == F.col("c"), F.col("c")).otherwise(0)) / m).alias("voc_oov_frac"), r6(zm).alias("voc_zipf_mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("z") * F.col("z") * F.col("c")) / m - zm * zm)), 5).alias("voc_zipf_std"), r6(F.sum(F.when(F.col("z") < 5, F.col("c")).otherwise(0)) / m).alias("voc_rare_frac"))
    rows = base.select(
        "doc_id", "n_words", r6(F.col("mattr")).alias("voc_mattr"), F.round("heaps", 5).alias("voc_heaps_slope"), r6(F.col("yule")).alias("voc_yule_k"), r6(F.col("hapax")).alias("voc_hapax_ratio"), r6(F.col("dis")).alias("voc_dis_ratio"),
        r6(F.when(F.col("n_content") >= 20, F.col("near_repeats") / F.col("n_content"))).alias("voc_local_repeat_frac"), r6(F.col("n_content") / F.col("n_words")).alias("voc_lexical_density"),
    )
    return rows.join(dense, "doc_id", "left")


def vocabulary_core(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, word_length, function_share, mattr) from one pass over a document's words."""
    base = vocabulary_base(docs, window)
    return base.select("doc_id", (F.col("chars") / F.col("n_words")).alias("word_length"), (F.col("n_function") / F.col("n_words")).alias("function_share"), "mattr")


def _grams(docs: DataFrame, n: int, chunk: int, least: int) -> DataFrame:
    """(doc_id, ch, m, g, c): counts of word n-grams within chunks of so many words."""
    w = S.word_arrays(docs).select("doc_id", F.transform("w", lambda x: x["word"]).alias("w"))
    made = F.expr(f"case when size(w) >= {n} then transform(sequence(1, size(w) - {n - 1}), i -> named_struct('n', size(w), 'g', concat_ws(' ', slice(w, i, {n})))) end")
    grams = w.select("doc_id", F.posexplode_outer(made).alias("pos", "x")).where("pos is not null").select("doc_id", "pos", "x.n", "x.g")
    # a gram belongs to a chunk if it lies in it whole
    ch = chunk_of(F.col("pos"), F.col("n"), chunk)
    grams = grams.where(ch == chunk_of(F.col("pos") + n - 1, F.col("n"), chunk)).withColumn("ch", ch)
    counted = grams.groupBy("doc_id", "ch", "g").agg(F.count("*").alias("c"))
    return counted.withColumn("m", F.sum("c").over(Window.partitionBy("doc_id", "ch"))).where(F.col("m") >= least)


def repetition(docs: DataFrame) -> DataFrame:
    out = docs.where("doc_id is not null and text is not null").select("doc_id")
    for n, name in ((2, "bigram"), (3, "trigram"), (4, "4gram")):
        g = _grams(docs, n, 150, 3)
        out = out.join(g.groupBy("doc_id").agg(r6(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"rep_{name}")), "doc_id", "left")
    five = _grams(docs, 5, 300, 56)
    phrase = five.groupBy("doc_id", "ch").agg(F.count_if(F.col("c") > 1).alias("r"), (F.max("m") + 4).alias("len")).groupBy("doc_id").agg(r6(F.avg(100 * F.col("r") / F.col("len"))).alias("rep_phrase5_per100"))
    return out.join(phrase, "doc_id", "left").join(block_share(docs), "doc_id", "left")


def block_share(docs: DataFrame, block: int = 8, step: int = 4) -> DataFrame:
    """(doc_id, rep_opening_word, rep_sentence_template) in blocks of eight sentences, four apart; three sentences at least.

    Mean shares of sentences whose first word, and whose first three words'
    classes (the template; there is no tagger), another one of the block has.
    """
    made = S.sentence_arrays(docs).select("doc_id", F.filter(F.transform("ss", lambda x: T.words(x["s"])), lambda w: F.size(w) > 0).alias("ws"))
    classes = F.transform("ws", lambda w: F.array_join(F.transform(F.slice(w, 1, 3), opening_class), " "))
    s = made.select("doc_id", F.transform("ws", lambda w: w[0]).alias("f"), classes.alias("c")).where(F.size("f") >= 3)

    def repeated(values: str) -> Column:
        starts = F.when(F.size(values) <= block, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size(values) - block + 1, F.lit(step)))
        parts = F.transform(starts, lambda i: F.slice(values, i, block))
        share = F.transform(parts, lambda b: F.size(F.filter(b, lambda v: F.size(F.filter(b, lambda u: u == v)) > 1)) / F.size(b))
        return r6(F.aggregate(share, F.lit(0.0), lambda a, x: a + x) / F.size(share))

    return s.select("doc_id", repeated("f").alias("rep_opening_word"), repeated("c").alias("rep_sentence_template"))


def transitions(docs: DataFrame) -> DataFrame:
    """Rates of transition phrases, English and Greek: a phrase counts once a sentence, wherever it stands (some only where they begin it); initial ones begin it."""
    s = S.sentence_table(docs).withColumn("t", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    phrases = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).alias("p")) for c, p in L.PHRASES])
    h = s.select("doc_id", "idx", "t", T.fold(F.col("s")).alias("low"), F.explode(phrases).alias("x")).where(F.col("t").contains(F.concat(F.lit(" "), F.col("x.p"), F.lit(" "))))
    h = h.where(~F.col("x.p").isin(L.INITIAL_ONLY) | F.col("t").startswith(F.concat(F.lit(" "), F.col("x.p"), F.lit(" "))))
    h = h.select("doc_id", "idx", "x.c", "x.p", F.col("t").startswith(F.concat(F.lit(" "), F.col("x.p"), F.lit(" "))).alias("first"), F.col("low").contains(F.concat(F.col("x.p"), F.lit(","))).alias("comma"))
    counts = [F.count_if(F.col("c") == c).cast("double").alias(f"c_{c}") for c in L.TRANSITIONS]
    per = h.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("first").alias("k1"), F.count_if("comma").alias("kc"), F.countDistinct("p").alias("types"), F.countDistinct("idx").alias("any"), *counts)
    x = s.groupBy("doc_id").agg(F.count("*").alias("ns")).join(per, "doc_id", "left")
    total, ns = F.col("total"), F.col("ns")
    at = h.select("doc_id", "idx").distinct().withColumn("gap", F.lead("idx").over(Window.partitionBy("doc_id").orderBy("idx")) - F.col("idx"))
    gaps = at.groupBy("doc_id").agg(r6(F.when(F.count("*") >= 3, cv(F.col("gap"), 1))).alias("tra_gap_cv"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = x.select(
        "doc_id", r6(zero(total) / ns).alias("tra_per_sent"), r6(zero(F.col("any")) / ns).alias("tra_sent_frac"), r6(F.col("k1") / total).alias("tra_initial_frac"), r6(F.col("kc") / total).alias("tra_comma_frac"),
        r6(F.when(total >= 2, F.col("types") / total)).alias("tra_diversity"), *[r6(zero(F.col(f"c_{c}")) / ns).alias(f"tra_{c}_rate") for c in L.TRANSITIONS],
        r6(entropy(F.when(total >= 2, F.array(*[F.col(f"c_{c}") for c in L.TRANSITIONS])), 7)).alias("tra_category_entropy"),
    )
    return out.join(gaps, "doc_id", "left")


OPENINGS = {"article": L.ARTICLES, "pronoun": sorted({*L.PRON1S, *L.PRON1P, *L.PRON2, *L.PRON3}), "cconj": L.CCONJ, "sconj": L.SCONJ, "preposition": L.PREPOSITIONS, "auxiliary": L.AUXILIARIES, "wh": "what who whom whose which where why how".split(), "determiner": "this that these those some any each every all both".split()}


def opening_class(first: Column) -> Column:
    out = F.lit("content")
    for k, v in reversed(list(OPENINGS.items())):
        out = F.when(first.isin(v), k).otherwise(out)
    return F.when(first.isNotNull(), out)


def openings(docs: DataFrame) -> DataFrame:
    """Entropy of sentence openings over 14 classes, at least three sentences; and proxies of clause counts.

    Subordinating and coordinating words stand for clauses: there is no parser.
    """
    s = S.sentence_table(docs).where(F.size("w") > 0).withColumn("o", opening_class(F.element_at("w", 1)))
    s = s.withColumns({"sub": T.lexicon_count(F.col("w"), L.SCONJ), "coo": T.lexicon_count(F.col("w"), L.CCONJ), "aux": T.lexicon_count(F.col("w"), L.AUXILIARIES)})
    kinds = [*OPENINGS, "content"]
    counts = F.array(*[F.count_if(F.col("o") == k).cast("double") for k in kinds])
    out = s.groupBy("doc_id").agg(F.when(F.count("*") >= 3, counts).alias("c"), r6(F.avg("sub")).alias("syn_subord_per_sent"), r6(F.avg("coo")).alias("syn_coord_per_sent"), r6(1 + F.avg(F.col("sub") + F.col("coo"))).alias("syn_clauses_per_sent"), r6(F.avg((F.col("aux") == 0).cast("double"))).alias("syn_fragment_frac"))
    return out.withColumn("syn_opening_entropy", r6(entropy(F.col("c"), 14))).drop("c")


def paragraph_stats(docs: DataFrame) -> DataFrame:
    """Variation of paragraph lengths and of their mean surprisal (of five words at least), and the share of paragraphs that open with a transition; two paragraphs at least."""
    s = S.sentence_table(docs).withColumn("t", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    first = reduce(lambda a, b: a | b, [F.col("t").startswith(f" {p} ") for _, p in L.PHRASES])
    p = s.groupBy("doc_id", "para").agg(F.sum(F.size("w")).alias("n"), F.min_by(first, "idx").alias("tr"))
    out = p.groupBy("doc_id").agg(r6(cv(F.col("n"))).alias("par_len_cv"), r6(F.when(F.count("*") >= 2, F.avg(F.col("tr").cast("double")))).alias("par_transition_initial"))
    where = s.select("doc_id", "idx", "para")
    x = surprisals(docs).join(where, ["doc_id", "idx"]).groupBy("doc_id", "para").agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m"), F.sum("c").alias("n")).where("n >= 5")
    return out.join(x.groupBy("doc_id").agg(F.round(std(F.col("m")), 5).alias("par_ppl_std")), "doc_id", "left")


#: Families by the prefix of a feature's name.
FAMILIES = {"ppl": "perplexity", "bur": "burstiness", "sty": "stylometric", "pun": "punctuation", "voc": "vocabulary", "syn": "syntax", "rep": "repetition", "tra": "transitions", "sem": "semantic", "par": "paragraph", "style": "consistency", "cp": "consistency"}


def family_of(name: Column) -> Column:
    out = F.lit("other")
    for k, v in FAMILIES.items():
        out = F.when(name.startswith(f"{k}_"), v).otherwise(out)
    return out


def model_features(names: list[str], window: bool = False) -> list[str]:
    """Names a model may use: none of paragraphs; for windows none of whole documents."""
    return [n for n in names if not n.startswith("par_") and not (window and n.startswith(("style_", "cp_")))]

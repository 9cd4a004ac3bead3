"""Queries of the feature families over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.operators import features as X
from textloom.operators import sentencetable as S
from textloom.plans import sqlparts as P
from textloom.plans.catalogue import query
from textloom.session import table


def _docs(spark, sf_dir):
    return S.documents(table(spark, sf_dir, "documents"))


def _in(words: list[str]) -> str:
    return "[" + ", ".join(P.q(w) for w in words) + "]"


_FREQ = f"{P.WORDS}, fr as (select word, count(*) as n, count(*) / sum(count(*)) over () as f from w group by word)"
_SUR = f"{_FREQ}, tk as (select doc_id, idx, pos, -log2(greatest(f, 1e-8)) as x from w join fr using (word))"


def _cv(x: str, least: int = 2) -> str:
    return f"round(case when count({x}) >= {least} and avg({x}) > 0 then stddev_pop({x}) / avg({x}) end, 6)"


def _burst(x: str) -> str:
    return f"round(case when count({x}) >= 2 and stddev_pop({x}) + avg({x}) > 0 then (stddev_pop({x}) - avg({x})) / (stddev_pop({x}) + avg({x})) end, 6)"


@query("q_word_frequencies", f"with {_FREQ} select word, n, round(f, 9) as f from fr")
def q_word_frequencies(spark, sf_dir):
    return X.word_frequencies(_docs(spark, sf_dir)).select("word", "n", F.round("f", 9).alias("f"))


@query(
    "q_surprisal_doc",
    f"""with {_SUR}, a as (select doc_id, round(avg(x), 6) as ppl_token_mean, round(quantile_cont(x, 0.5), 6) as ppl_token_median, round(case when count(*) >= 10 then quantile_cont(x, 0.9) end, 6) as ppl_token_q90, round(case when count(*) >= 10 then quantile_cont(x, 0.1) end, 6) as ppl_token_q10, round(case when count(*) >= 2 then stddev_pop(x) end, 5) as bur_ppl_token_std from tk group by doc_id),
s1 as (select doc_id, idx, avg(x) as m from tk group by doc_id, idx having count(*) >= 3), s2 as (select *, case when count(*) over f = 3 then avg(m) over f end as roll from s1 window f as (partition by doc_id order by idx rows between current row and 2 following)),
b as (select doc_id, round(avg(m), 6) as ppl_sent_mean, round(quantile_cont(m, 0.5), 6) as ppl_sent_median, round(min(m), 6) as ppl_sent_min, round(max(m), 6) as ppl_sent_max, round(case when count(*) >= 2 then stddev_pop(m) end, 6) as bur_ppl_sent_std, {_cv('m')} as bur_ppl_sent_cv, {_burst('m')} as bur_ppl_sent_b,
 round(case when count(*) >= 3 then quantile_cont(m, 0.9) - quantile_cont(m, 0.1) end, 6) as bur_ppl_sent_range, round(case when count(*) >= 4 then stddev_pop(roll) end, 6) as bur_ppl_rolling_std from s2 group by doc_id)
select a.*, b.* exclude (doc_id) from a left join b on a.doc_id = b.doc_id""",
)
def q_surprisal_doc(spark, sf_dir):
    return X.predictability(_docs(spark, sf_dir))


@query("q_burstiness_sentlen", f"with {P.SENTS}, x as (select doc_id, nullif(len(w), 0) as n, case when len(w) >= 5 then len(list_distinct(w)) / len(w) end as ttr from s) select doc_id, round(case when count(n) >= 2 then stddev_pop(n) end, 6) as bur_sent_len_std, {_cv('n')} as bur_sent_len_cv, {_burst('n')} as bur_sent_len_b, round(case when count(ttr) >= 2 then stddev_pop(ttr) end, 6) as bur_vocab_std from x group by doc_id")
def q_burstiness_sentlen(spark, sf_dir):
    return X.burstiness(_docs(spark, sf_dir))


_END = """case when e in ('...', '…') then 'ellipsis' when e = '?' then 'question' when e = '!' then 'exclaim' when e = '.' then 'period' else 'none' end"""
_ENDS = f"""{P.SENTS}, en0 as (select *, regexp_extract(s, '(\\.\\.\\.|…|[.?!;])["''\\)\\]»”]*$', 1) as e from s), en as (select *, len(w) as n, {_END} as fin from en0)"""
_LEX = ", ".join(f"round(sum(len(list_filter(w, lambda v: list_contains({_in(v)}, v)))) / greatest(sum(n), 1), 6) as sty_{k}_frac" for k, v in X.LEXICONS.items())


@query(
    "q_stylometry",
    f"""with {_ENDS}, l as (select doc_id, unnest(w) as v from en), lw as (select doc_id, round(avg(length(v)), 6) as sty_word_len_mean, round(stddev_pop(length(v)), 5) as sty_word_len_std, round(avg(case when length(v) >= 7 then 1.0 else 0.0 end), 6) as sty_long_word_frac, round(100 * avg(case when contains(v, '''') then 1.0 else 0.0 end), 6) as sty_contraction_rate from l group by doc_id),
a as (select doc_id, round(avg(n), 6) as sty_sent_len_mean, round(quantile_cont(n, 0.5), 6) as sty_sent_len_median, round(case when count(*) >= 3 then quantile_cont(n, 0.1) end, 6) as sty_sent_len_p10, round(case when count(*) >= 3 then quantile_cont(n, 0.9) end, 6) as sty_sent_len_p90, round(avg(case when n < 8 then 1.0 else 0.0 end), 6) as sty_short_sent_frac, round(avg(case when n > 30 then 1.0 else 0.0 end), 6) as sty_long_sent_frac,
 round(avg(case when fin = 'question' then 1.0 else 0.0 end), 6) as sty_question_frac, round(avg(case when fin = 'exclaim' then 1.0 else 0.0 end), 6) as sty_exclaim_frac, {_LEX} from en group by doc_id)
select a.*, coalesce(sty_word_len_mean, 0) as sty_word_len_mean, coalesce(sty_word_len_std, 0) as sty_word_len_std, coalesce(sty_long_word_frac, 0) as sty_long_word_frac, coalesce(sty_contraction_rate, 0) as sty_contraction_rate from a left join lw on a.doc_id = lw.doc_id""",
)
def q_stylometry(spark, sf_dir):
    return X.stylometry(_docs(spark, sf_dir))


def _ent(counts: str, k: int) -> str:
    return f"round(case when list_sum({counts}) > 0 then -list_sum(list_transform({counts}, lambda v: case when v > 0 then v / list_sum({counts}) * ln(v / list_sum({counts})) else 0 end)) / ln({k}) end, 6)"


_PC = {k: f"len(regexp_extract_all(s, {P.q(p)}))" for k, p in X.PUNCTUATION.items()}


@query(
    "q_punctuation",
    f"""with {_ENDS}, c as (select doc_id, fin, n, {', '.join(f'{v} as x_{k}' for k, v in _PC.items())} from en),
a as (select doc_id, {', '.join(f'round(100 * sum(x_{k}) / greatest(sum(n), 1), 6) as pun_{k}_rate' for k in _PC)}, round(100 * sum({' + '.join(f'x_{k}' for k in _PC)}) / greatest(sum(n), 1), 6) as pun_total_rate, round(case when count(*) >= 2 then stddev_pop(x_comma) end, 6) as pun_comma_per_sent_std, round(avg(case when fin = 'none' then 1.0 else 0.0 end), 6) as pun_no_end_frac,
 [{', '.join(f'sum(x_{k})::double' for k in _PC)}] as types, [{', '.join(f"count(*) filter (where fin = '{e}')::double" for e in ('period', 'question', 'exclaim', 'ellipsis', 'none'))}] as ends, count(*) as ns from c group by doc_id),
m as (select doc_id, idx, generate_subscripts(l, 1) as k, unnest(l) as mark from (select doc_id, idx, regexp_extract_all(s, '[,;:—–()"“”«»…?!.]') as l from s)), mm as (select doc_id, mark || lead(mark) over (partition by doc_id order by idx, k) as pair from m), g as (select doc_id, pair, count(*)::double as c from mm where pair is not null group by 1, 2), gg as (select doc_id, list(c) as cs from g group by doc_id having sum(c) >= 3)
select a.* exclude (types, ends, ns), {_ent('types', 10)} as pun_type_entropy, case when ns >= 2 then {_ent('ends', 5)} end as pun_end_entropy, {_ent('cs', 100)} as pun_transition_entropy from a left join gg on a.doc_id = gg.doc_id""",
)
def q_punctuation(spark, sf_dir):
    return X.punctuation(_docs(spark, sf_dir))


def _chunk(pos: str, n: str, size: int) -> str:
    return f"least({pos} // {size}, greatest(0, {n} // {size} - case when {n} % {size} * 2 >= {size} then 0 else 1 end))"


@query(
    "q_vocabulary",
    f"""with {_FREQ}, dw as (select doc_id, list(word order by pos) as w, count(*) as n from w group by doc_id),
ma as (select doc_id, n as n_words, round(case when n <= 50 then len(list_distinct(w)) / n else list_avg(list_transform(range(1, n - 48), lambda i: len(list_distinct(w[i:i + 49])) / 50)) end, 6) as voc_mattr from dw),
he as (select doc_id, round(regr_slope(ln(t), ln(i)), 5) as voc_heaps_slope from (select doc_id, n, i, len(list_distinct(w[1:i])) as t from (select doc_id, w, n, unnest(range(10, n + 1, 10)) as i from dw where n >= 120)) group by doc_id),
ty as (select doc_id, word, count(*) as c from w group by 1, 2), yu as (select doc_id, round(case when sum(c) >= 20 then 1e4 * (sum(c * c) - sum(c)) / (sum(c) * sum(c)) end, 6) as voc_yule_k from ty group by doc_id),
wn as (select w.*, count(*) over (partition by doc_id) as n from w), ch as (select doc_id, {_chunk('pos', 'n', 100)} as ch, word, count(*) as c from wn group by 1, 2, 3), cc as (select doc_id, ch, count(*) filter (where c = 1) / count(*) as h, count(*) filter (where c = 2) / count(*) as d from ch group by 1, 2 having sum(c) >= 50), ha as (select doc_id, round(avg(h), 6) as voc_hapax_ratio, round(avg(d), 6) as voc_dis_ratio from cc group by doc_id),
ct as (select doc_id, word, count(*) as here from w group by 1, 2), co as (select w.doc_id, word, fr.n = ct.here as only_here, log10(f) + 9 as z, row_number() over (partition by doc_id order by pos) as cp from w join fr using (word) join ct using (doc_id, word) where not list_contains({_in(L.FUNCTION)}, word)), lo as (select *, cp - lag(cp) over (partition by doc_id, word order by cp) as gap from co),
ld as (select doc_id, count(*) as m, round(case when count(*) >= 20 then count(*) filter (where gap <= 50) / count(*) end, 6) as voc_local_repeat_frac, round(avg(z), 6) as voc_zipf_mean, round(stddev_pop(z), 5) as voc_zipf_std, round(avg(case when z < 5 then 1.0 else 0.0 end), 6) as voc_rare_frac, round(avg(case when only_here then 1.0 else 0.0 end), 6) as voc_oov_frac from lo group by doc_id)
select ma.*, voc_heaps_slope, voc_yule_k, voc_hapax_ratio, voc_dis_ratio, voc_local_repeat_frac, voc_zipf_mean, voc_zipf_std, voc_rare_frac, voc_oov_frac, round(coalesce(m, 0) / n_words, 6) as voc_lexical_density from ma left join he using (doc_id) join yu using (doc_id) left join ha using (doc_id) left join ld using (doc_id)""",
)
def q_vocabulary(spark, sf_dir):
    return X.vocabulary(_docs(spark, sf_dir))


def _gram_sql(n: int, size: int, least: int, name: str) -> str:
    return f"""{name}0 as (select doc_id, n, unnest(range(1, n - {n - 2})) as i, w from dw where n >= {n}), {name}1 as (select doc_id, {_chunk('(i - 1)', 'n', size)} as ch, {_chunk(f'(i + {n - 2})', 'n', size)} as ch2, array_to_string(w[i:i + {n - 1}], ' ') as g from {name}0),
{name}2 as (select doc_id, ch, g, count(*) as c from {name}1 where ch = ch2 group by 1, 2, 3), {name}3 as (select *, sum(c) over (partition by doc_id, ch) as m from {name}2), {name} as (select * from {name}3 where m >= {least})"""


_CLASS = "case " + " ".join(f"when list_contains({_in(v)}, v) then {P.q(k)}" for k, v in X.OPENINGS.items()) + " else 'content' end"


def _repeated(c: str) -> str:
    return f"round(list_avg(list_transform(st, lambda i: len(list_filter({c}[i:i + 7], lambda v: len(list_filter({c}[i:i + 7], lambda u: u = v)) > 1)) / len({c}[i:i + 7]))), 6)"


@query(
    "q_repetition",
    f"""with {P.WORDS}, dw as (select doc_id, list(word order by pos) as w, count(*) as n from w group by doc_id), {_gram_sql(2, 150, 3, 'a')}, {_gram_sql(3, 150, 3, 'b')}, {_gram_sql(4, 150, 3, 'e')}, {_gram_sql(5, 300, 56, 'f')},
a9 as (select doc_id, round(coalesce(sum(c) filter (where c > 1), 0) / sum(c), 6) as rep_bigram from a group by 1), b9 as (select doc_id, round(coalesce(sum(c) filter (where c > 1), 0) / sum(c), 6) as rep_trigram from b group by 1), e9 as (select doc_id, round(coalesce(sum(c) filter (where c > 1), 0) / sum(c), 6) as rep_4gram from e group by 1),
f9 as (select doc_id, round(avg(100 * r / l), 6) as rep_phrase5_per100 from (select doc_id, ch, count(*) filter (where c > 1) as r, max(m) + 4 as l from f group by 1, 2) group by 1),
fw as (select doc_id, list(w[1] order by idx) as l, list(array_to_string(list_transform(w[1:3], lambda v: {_CLASS}), ' ') order by idx) as c from s where len(w) > 0 group by doc_id having count(*) >= 3), bs as (select doc_id, l, c, case when len(l) <= 8 then [1] else range(1, len(l) - 6, 4) end as st from fw), bx as (select doc_id, {_repeated('l')} as rep_opening_word, {_repeated('c')} as rep_sentence_template from bs)
select d.doc_id, rep_bigram, rep_trigram, rep_4gram, rep_phrase5_per100, rep_opening_word, rep_sentence_template from d left join a9 using (doc_id) left join b9 using (doc_id) left join e9 using (doc_id) left join f9 using (doc_id) left join bx using (doc_id)""",
)
def q_repetition(spark, sf_dir):
    return X.repetition(_docs(spark, sf_dir))


_PH = ", ".join(f"{{'c': '{c}', 'p': '{p}'}}" for c, p in L.PHRASES)


@query(
    "q_transitions",
    f"""with {P.SENTS}, t as (select doc_id, idx, s, ' ' || array_to_string(w, ' ') || ' ' as t from s), ph as (select unnest([{_PH}]) as x), h as (select doc_id, idx, x.c as c, x.p as p, starts_with(t, ' ' || x.p || ' ') as f, contains({P.fold('s')}, x.p || ',') as k from t cross join ph where contains(t, ' ' || x.p || ' ') and (not list_contains({_in(L.INITIAL_ONLY)}, x.p) or starts_with(t, ' ' || x.p || ' '))),
n as (select doc_id, count(*) as ns from s group by doc_id), per as (select doc_id, idx, count(*) as k from h group by 1, 2), g as (select doc_id, lead(idx) over (partition by doc_id order by idx) - idx as gap from per), gc as (select doc_id, case when count(*) >= 3 then {_cv('gap', 1)} end as tra_gap_cv from g group by doc_id),
a as (select doc_id, count(*) as total, count(*) filter (where f) as f, count(*) filter (where k) as k, count(distinct p) as types, count(distinct idx) as with_any, {', '.join(f"count(*) filter (where c = '{c}')::double as c_{c}" for c in L.TRANSITIONS)} from h group by doc_id),
z as (select n.doc_id, ns, coalesce(total, 0) as total, f, k, types, coalesce(with_any, 0) as wa, {', '.join(f'coalesce(c_{c}, 0) as c_{c}' for c in L.TRANSITIONS)}, case when total >= 2 then [{', '.join(f'c_{c}' for c in L.TRANSITIONS)}] end as cats from n left join a using (doc_id))
select doc_id, round(total / ns, 6) as tra_per_sent, round(wa / ns, 6) as tra_sent_frac, round(f / nullif(total, 0), 6) as tra_initial_frac, round(k / nullif(total, 0), 6) as tra_comma_frac, round(case when total >= 2 then types / total end, 6) as tra_diversity, {', '.join(f'round(c_{c} / ns, 6) as tra_{c}_rate' for c in L.TRANSITIONS)}, {_ent('cats', 7)} as tra_category_entropy, tra_gap_cv from z left join gc using (doc_id)""",
)
def q_transitions(spark, sf_dir):
    return X.transitions(_docs(spark, sf_dir))


_OPEN = "case " + " ".join(f"when list_contains({_in(v)}, w[1]) then '{k}'" for k, v in X.OPENINGS.items()) + " else 'content' end"


def _lc(words: list[str]) -> str:
    return f"len(list_filter(w, lambda v: list_contains({_in(words)}, v)))"


@query(
    "q_opening_entropy",
    f"""with {P.SENTS}, o as (select doc_id, {_OPEN} as o, {_lc(L.SCONJ)} as sub, {_lc(L.CCONJ)} as coo, {_lc(L.AUXILIARIES)} as aux from s where len(w) > 0),
a as (select doc_id, case when count(*) >= 3 then [{', '.join(f"count(*) filter (where o = '{k}')::double" for k in [*X.OPENINGS, 'content'])}] end as c, round(avg(sub), 6) as syn_subord_per_sent, round(avg(coo), 6) as syn_coord_per_sent, round(1 + avg(sub + coo), 6) as syn_clauses_per_sent, round(avg(case when aux = 0 then 1.0 else 0.0 end), 6) as syn_fragment_frac from o group by doc_id)
select * exclude (c), {_ent('c', 14)} as syn_opening_entropy from a""",
)
def q_opening_entropy(spark, sf_dir):
    return X.openings(_docs(spark, sf_dir))


@query("q_paragraph_stats", f"with {_SUR}, t as (select doc_id, para, idx, len(w) as n, ' ' || array_to_string(w, ' ') || ' ' as t from s), p as (select doc_id, para, sum(n) as n, arg_min({' or '.join(f'''starts_with(t, ' {p} ')''' for _, p in L.PHRASES)}, idx) as tr from t group by 1, 2), a as (select doc_id, {_cv('n')} as par_len_cv, round(case when count(*) >= 2 then avg(case when tr then 1.0 else 0.0 end) end, 6) as par_transition_initial from p group by doc_id), b as (select doc_id, round(case when count(*) >= 2 then stddev_pop(m) end, 5) as par_ppl_std from (select tk.doc_id, para, avg(x) as m from tk join s on s.doc_id = tk.doc_id and s.idx = tk.idx group by 1, 2 having count(*) >= 5) group by 1) select a.*, par_ppl_std from a left join b using (doc_id)")
def q_paragraph_stats(spark, sf_dir):
    return X.paragraph_stats(_docs(spark, sf_dir))


@query("q_feature_family", "select * from (values ('ppl_token_mean', 'perplexity', true), ('par_len_cv', 'paragraph', false), ('style_drift_mean', 'consistency', false), ('voc_mattr', 'vocabulary', true), ('cp_max_stat', 'consistency', false)) t(feature, family, in_windows)")
def q_feature_family(spark, sf_dir):
    names = ["ppl_token_mean", "par_len_cv", "style_drift_mean", "voc_mattr", "cp_max_stat"]
    return spark.createDataFrame([(n,) for n in names], "feature string").select("feature", X.family_of(F.col("feature")).alias("family"), F.col("feature").isin(X.model_features(names, window=True)).alias("in_windows"))


@query(
    "q_doc_stylometry",
    f"""with {P.WORDS}, dw as (select doc_id, list(word order by pos) as w, count(*) as n from w group by doc_id), x as (select doc_id, n, list_avg(list_transform(w, lambda v: length(v))) as wl, len(list_filter(w, lambda v: list_contains({_in(L.FUNCTION)}, v))) / n as fu, case when n <= 50 then len(list_distinct(w)) / n else list_avg(list_transform(range(1, n - 48), lambda i: len(list_distinct(w[i:i + 49])) / 50)) end as ma from dw)
select coalesce(lang, 'none') as lang, coalesce(label, -1) as label, count(*) as n_documents, round(avg(wl), 5) as word_length, round(avg(fu), 5) as function_share, round(avg(ma), 5) as mattr from x join d using (doc_id) group by 1, 2""",
)
def q_doc_stylometry(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    voc = X.vocabulary_core(docs)
    return docs.select("doc_id", "lang", "label").join(voc, "doc_id").groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n_documents"), F.round(F.avg("word_length"), 5).alias("word_length"), F.round(F.avg("function_share"), 5).alias("function_share"), F.round(F.avg("mattr"), 5).alias("mattr"))

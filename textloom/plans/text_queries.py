"""Queries of the text operators: projections, splitting and normalising."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.functions.langlabels import DETECTED
from textloom.functions.stopwords import STOPWORDS
from textloom.operators import sentencetable as S
from textloom.plans import sqlparts as P
from textloom.plans.catalogue import query
from textloom.session import table


def _docs(spark, sf_dir):
    return S.documents(table(spark, sf_dir, "documents"))


@query("q_word_counts", f"with {P.DOCS}, x as (select doc_id, {P.words('text')} as w from d) select doc_id, len(w) as n_words, len(list_distinct(w)) as n_types, len(w) >= 40 as long_enough from x")
def q_word_counts(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_types"), (F.size("w") >= 40).alias("long_enough"))


@query("q_fold_diacritics", f"with {P.DOCS} select doc_id, md5({P.fold('text')}) as folded from d")
def q_fold_diacritics(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


_NORMALIZE_SQL = f"translate(translate(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {P.q(T.INVISIBLE)}, ''), {P.q(T.MARKS)}, {P.q(T.PLAIN_MARKS)})"
for _pattern, _to in ((r"(\d)[‐-–](\d)", r"'\1-\2'"), (r"[ \t]*(?:—|–|--)[ \t]*", "' — '"), (r"(?m)^[ ,;]+", "''"), (r"([.!?])[;,]+(\s|$)", r"'\1\2'"), (r",(?:\s*,)+", "','"), (r" +([,;:])", r"'\1'"), (r"(?m)^[ \t]*[•●▪*][ \t]+", "'- '"), (r"[ \t]{2,}", "' '"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")):
    _NORMALIZE_SQL = f"regexp_replace({_NORMALIZE_SQL}, '{_pattern}', {_to}, 'g')"


@query("q_normalize_text", f"with {P.DOCS} select doc_id, md5({_NORMALIZE_SQL}) as normal, length({_NORMALIZE_SQL}) as n_normal from d")
def q_normalize_text(spark, sf_dir):
    t = T.normalize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("normal"), F.length(t).cast("long").alias("n_normal"))


@query("q_paragraphs", f"with {P.PARAS} select doc_id, count(*) as n_paragraphs, count(*) filter (where {P.is_heading('p')}) as n_headings, max(length(p)) as longest from pa group by doc_id")
def q_paragraphs(spark, sf_dir):
    p = S.paragraph_table(_docs(spark, sf_dir))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_if(T.is_heading(F.col("p"))).alias("n_headings"), F.max(F.length("p")).cast("long").alias("longest"))


@query(
    "q_hard_wrap",
    rf"""with {P.DOCS}, b as (select doc_id, generate_subscripts(bs, 1) as k, unnest(bs) as block from (select doc_id, regexp_split_to_array(text, '\n[ \t]*\n') as bs from d)),
x as (select *, string_split(block, chr(10)) as l from b), y as (select *, l[1:greatest(len(l) - 1, 1)] as head from x),
z as (select *, list_aggregate(list_transform(head, lambda v: length(v)), 'quantile_cont', 0.5) as median from y),
t as (select doc_id, k, case when len(l) >= 3 and median between 50 and 100 and 2 * len(list_filter(head, lambda v: not regexp_matches(v, '[.!?:;]["''\)\]]?\s*$'))) >= len(head)
 then regexp_replace(block, '\s*\n\s*', ' ', 'g') else regexp_replace(block, '[ \t]*\n[ \t]*([\p{{Ll}}\d])', ' \1', 'g') end as u, len(l) as n from z)
select doc_id, count(*) as n_blocks, md5(string_agg(u, chr(10) || chr(10) order by k)) as joined, sum(n)::bigint as n_lines from t group by doc_id""",
)
def q_hard_wrap(spark, sf_dir):
    blocks = _docs(spark, sf_dir).select("doc_id", F.split("text", r"\n[ \t]*\n").alias("bs"))
    joined = F.array_join(F.transform("bs", T.unwrap), "\n\n")
    lines = F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + F.size(F.split(b, "\n")))
    return blocks.select("doc_id", F.size("bs").cast("long").alias("n_blocks"), F.md5(joined).alias("joined"), lines.alias("n_lines"))


@query("q_sentence_split", f"with {P.SENTS} select doc_id, para, idx, len(w) as n_words, length(s) as n_chars from s")
def q_sentence_split(spark, sf_dir):
    return S.sentence_table(_docs(spark, sf_dir)).select("doc_id", "para", "idx", F.size("w").alias("n_words"), F.length("s").alias("n_chars"))


@query("q_sentence_lengths", f"with {P.SENTS} select floor(len(w) / 5)::int * 5 as bin, count(*) as n from s group by 1")
def q_sentence_lengths(spark, sf_dir):
    return S.sentence_table(_docs(spark, sf_dir)).groupBy((F.floor(F.size("w") / 5) * 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("q_document_builder", f"with {P.SENTS} select doc_id, count(*) as n_sentences, count(distinct para) as n_paragraphs, sum(len(w))::bigint as n_words, max(dr) as last_paragraph from (select *, dense_rank() over (partition by doc_id order by para) as dr from s) group by doc_id")
def q_document_builder(spark, sf_dir):
    s = S.sentence_table(_docs(spark, sf_dir))
    # paragraphs are numbered again without the headings; the count of kept ones is the last number
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.countDistinct("para").alias("n_paragraphs"), F.sum(F.size("w")).alias("n_words"), F.countDistinct("para").alias("last_paragraph"))


@query(
    "q_trim_tail",
    r"""with x as (select id, regexp_replace(text, '\s+$', '') as t from (select id, any_value(text) as text from samples where id is not null and text is not null group by id)),
y as (select id, t, regexp_extract(t, '(?s)^(.*[.!?]["''\)\]]?)\s', 1) as head from x)
select id, md5(case when regexp_matches(t, '[.!?]["''\)\]]?$') or head = '' then t else head end) as trimmed, greatest(1, len(regexp_extract_all(t, '[.!?]+(?:\s|$)'))) as n_quick from y""",
)
def q_trim_tail(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("id is not null and text is not null").select("id", F.regexp_replace("text", r"\s+$", "").alias("t"))
    return s.select("id", F.md5(T.trim_incomplete_tail(F.col("t"))).alias("trimmed"), T.sentence_count_quick(F.col("t")).alias("n_quick")).distinct()


@query("q_truncate_words", f"with {P.SENTS}, c as (select *, sum(len(w)) over (partition by doc_id order by idx) as cum from s) select doc_id, string_agg(s, ' ' order by idx) as cut, sum(len(w))::bigint as n_words from c where cum - len(w) < 100 group by doc_id")
def q_truncate_words(spark, sf_dir):
    from textloom.operators.corpus import truncate_words

    return truncate_words(S.sentence_table(_docs(spark, sf_dir)), F.lit(100)).select("doc_id", F.col("text").alias("cut"), "n_words")


def _hits_sql(k: str) -> str:
    known = ", ".join(P.q(x) for x in STOPWORDS[k].split())
    return f"len(list_filter(w, lambda v: list_contains([{known}], v)))"


@query(
    "q_language_detect",
    f"""with {P.DOCS}, x as (select doc_id, lang, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as n, length(regexp_replace(text, '[^\\p{{Greek}}]', '', 'g')) as g, list_transform(regexp_extract_all(lower(text), '\\p{{L}}+')[1:3000], lambda v: replace(v, 'ς', 'ς')) as w from d),
y as (select doc_id, n, g, [{', '.join(_hits_sql(k) + ' / greatest(len(w), 1)' for k in DETECTED if k != 'el')}] as r from x)
select doc_id, case when n < 20 then 'und' when g * 2 >= n then 'el' when list_max(r) < 0.08 then 'und' else ['en', 'fr', 'de', 'es', 'it', 'pt', 'nl'][list_position(r, list_max(r))] end as guess,
case when n < 20 then 0.0 when g * 2 >= n then round(g / n, 6) when list_max(r) < 0.08 then 0.0 else round(least(1.0, list_max(r) / 0.35), 6) end as confidence from y""",
)
def q_language_detect(spark, sf_dir):
    from textloom.operators.language import detect_language

    return detect_language(_docs(spark, sf_dir)).select("doc_id", "guess", "confidence")


@query("q_strip_labels", r"""with x as (select gen_id, any_value(text) as t, any_value(prompt) as p from generations where gen_id is not null and text is not null group by gen_id),
y as (select gen_id, case when p is not null and p <> '' and starts_with(t, p) then substr(t, length(p) + 1) else t end as u from x)
select gen_id, md5(regexp_replace(u, '^(?:[ \t]*\n|[ \t]*(?i:prompt|title|essay|answer|response|text|output|question|abstract|story) ?:[^\n]*\n){1,3}', '')) as cleaned from y""")
def q_strip_labels(spark, sf_dir):
    g = table(spark, sf_dir, "generations").where("gen_id is not null and text is not null").select("gen_id", "text", "prompt")
    body = F.when((F.coalesce("prompt", F.lit("")) != "") & F.expr("startswith(text, prompt)"), F.expr("substring(text, length(prompt) + 1)")).otherwise(F.col("text"))
    return g.select("gen_id", F.md5(T.strip_labels(body)).alias("cleaned")).distinct()


@query("q_excerpt", r"""select distinct gen_id, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:12], ' ') as excerpt from generations where gen_id is not null and text is not null""")
def q_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "generations").where("gen_id is not null and text is not null").select("gen_id", T.excerpt(F.col("text"), 12).alias("excerpt")).distinct()


_GENRE_SQL = "case domain " + " ".join(f"when {P.q(k)} then {P.q(v)}" for k, v in L.GENRES.items()) + " else 'unknown' end"


@query(
    "q_make_sample",
    f"""select doc_id, coalesce(source, '') || ':' || coalesce(domain, 'unknown') || ':' || coalesce(generator, 'none') || ':' || substr(sha1(text), 1, 16) as sample_id, len({P.words('text')}) as n_words,
case when label = 1 then 'ai' when label = 0 then 'human' end as author_type, {_GENRE_SQL} as genre, coalesce(group_id, coalesce(source, '') || ':' || substr(sha1(text), 1, 16)) as group_key from documents where doc_id is not null and text is not null""",
)
def q_make_sample(spark, sf_dir):
    from textloom.operators.corpus import make_samples

    return make_samples(_docs(spark, sf_dir)).select("doc_id", "sample_id", "n_words", "author_type", "genre", "group_key")


@query("q_hybrid_class", "select id, case when f < 0.15 then 0 when f < 0.5 then 1 when f < 0.85 then 2 when f is not null then 3 end as computed_class, hybrid_class from (select distinct id, ai_fraction as f, hybrid_class from samples where id is not null)")
def q_hybrid_class(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("id is not null").select("id", "ai_fraction", "hybrid_class").distinct()
    return s.select("id", T.hybrid_class(F.col("ai_fraction")).alias("computed_class"), "hybrid_class")


_TASKS = ["continue", "paraphrase", "paraphrase_ai", "polish"]


@query("q_task_assignment", f"select id, task from (select id, label, [{', '.join(map(P.q, _TASKS))}][(row_number() over (order by id) - 1) % {len(_TASKS)} + 1] as task from (select id, max(label) as label from samples where id is not null group by id)) where label = case when task = 'paraphrase_ai' then 1 else 0 end")
def q_task_assignment(spark, sf_dir):
    """Tasks in turn over all samples, kept where the task takes the sample's label."""
    from textloom.operators.corpus import round_robin

    rows = table(spark, sf_dir, "samples").where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    wanted = F.when(F.col("task") == "paraphrase_ai", 1).otherwise(0)
    return round_robin(rows, "id", _TASKS, "task").where(F.col("label") == wanted).select("id", "task")

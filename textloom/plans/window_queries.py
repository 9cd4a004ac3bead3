"""Queries of window operators, style change, segments and text overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.operators import sentencetable as S
from textloom.operators import similarity as M
from textloom.operators import windows as W
from textloom.operators.features import PUNCTUATION
from textloom.plans import sqlparts as P
from textloom.plans.catalogue import query
from textloom.session import table


def _docs(spark, sf_dir):
    return S.documents(table(spark, sf_dir, "documents"))


def _sents(spark, sf_dir):
    return S.sentence_table(_docs(spark, sf_dir))


_WIN = f"{P.SENTS}, sn as (select *, count(*) over (partition by doc_id) as n from s), cw as (select doc_id, idx as centre, unnest(range(greatest(0, least(idx - 2, n - 5)), least(greatest(0, least(idx - 2, n - 5)) + 5, n))) as idx from sn)"


@query("q_window_centered", f"with {_WIN} select doc_id, centre, min(idx) as first, max(idx) as last, count(*) as n from cw group by 1, 2")
def q_window_centered(spark, sf_dir):
    return W.centred_windows(_sents(spark, sf_dir)).groupBy("doc_id", "centre").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))


@query("q_rolling_series", f"with {_WIN}, j as (select cw.doc_id, centre, len(w) as k, w from cw join s on s.doc_id = cw.doc_id and s.idx = cw.idx) select doc_id, centre, count(*) as n, round(avg(k), 6) as len_mean, round(stddev_pop(k), 6) as len_std, round(case when avg(k) > 0 then stddev_pop(k) / avg(k) end, 6) as len_cv, round(case when sum(k) > 0 then len(list_distinct(flatten(list(w)))) / sum(k) end, 6) as ttr from j group by 1, 2")
def q_rolling_series(spark, sf_dir):
    return W.window_features(_sents(spark, sf_dir))


_CLASSES = [L.ARTICLES, sorted({*L.PRON1S, *L.PRON1P, *L.PRON2, *L.PRON3}), L.CCONJ, L.SCONJ, L.PREPOSITIONS, L.AUXILIARIES]
_PUN = ", ".join(f"len(regexp_extract_all(s, {P.q(p)}))" for p in PUNCTUATION.values())
_CLS = ", ".join(f"len(list_filter(w, lambda v: list_contains([{', '.join(P.q(x) for x in c)}], v)))" for c in _CLASSES)
_SUMS = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])::double" for i in range(n)) + "]"


def _js(a: str, b: str) -> str:
    p, q = f"(({a}[i] + 0.5) / (list_sum({a}) + 0.5 * len({a})))", f"(({b}[i] + 0.5) / (list_sum({b}) + 0.5 * len({b})))"
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({p} * log2({p} / (({p} + {q}) / 2)) + {q} * log2({q} / (({p} + {q}) / 2))) / 2))"


@query(
    "q_style_drift",
    f"""with {P.SENTS}, c as (select doc_id, idx, [{_PUN}] as pun, [{_CLS}, len(w)] as cls, count(*) over (partition by doc_id) as n from s), k as (select doc_id, unnest(range(0, n - 4, 2)) as lo from (select distinct doc_id, n from c where n >= 7)),
g as (select k.doc_id, lo, {_SUMS('pun', len(PUNCTUATION))} as pun, {_SUMS('cls', 7)} as cls from k join c on c.doc_id = k.doc_id and idx between lo and lo + 4 group by 1, 2), l as (select *, lag(pun) over (partition by doc_id order by lo) as pun0, lag(cls) over (partition by doc_id order by lo) as cls0 from g),
dd as (select doc_id, ({_js('pun0', 'pun')} + {_js('cls0', 'cls')}) / 2 as d from l where pun0 is not null) select doc_id, round(avg(d), 6) as style_drift_mean, round(max(d), 6) as style_drift_max, round(stddev_pop(d), 6) as style_drift_std from dd group by doc_id""",
)
def q_style_drift(spark, sf_dir):
    return W.style_drift(_sents(spark, sf_dir))


_Z = ", ".join(f"case when stddev_pop(x{i}) over p > 1e-9 then (x{i} - avg(x{i}) over p) / stddev_pop(x{i}) over p end as z{i}" for i in range(4))
_BOUND = f"""{P.SENTS}, x as (select doc_id, idx, len(w)::double as x0, case when len(w) > 0 then list_sum(list_transform(w, lambda v: length(v))) / len(w) else 0.0 end as x1, len(regexp_extract_all(s, ','))::double as x2, case when len(w) > 0 then len(list_distinct(w)) / len(w) else 1.0 end as x3 from s),
z as (select doc_id, idx, count(*) over p as n, {_Z} from x window p as (partition by doc_id)),
bd as (select a.doc_id, a.idx as b, a.n, {', '.join(f'avg(c.z{i}) filter (where c.idx >= a.idx) - avg(c.z{i}) filter (where c.idx < a.idx) as g{i}' for i in range(4))}, count(*) filter (where c.idx < a.idx) as l, count(*) filter (where c.idx >= a.idx) as r from z a join z c on c.doc_id = a.doc_id and c.idx between a.idx - 4 and a.idx + 3 where a.idx >= 3 and a.idx <= a.n - 3 group by 1, 2, 3),
bt as (select doc_id, b, list_filter([{', '.join(f'g{i} * g{i}' for i in range(4))}], lambda v: v is not null) as q, l, r from bd), bs as (select doc_id, b, round(list_avg(q) / (1 / l + 1 / r), 6) as t from bt where len(q) > 0)"""


@query("q_boundary_stat", f"with {_BOUND} select * from bs")
def q_boundary_stat(spark, sf_dir):
    return W.boundary_statistic(_sents(spark, sf_dir))


@query("q_cp_feature", f"with {_BOUND} select doc_id, round(max(t) / (1 + ln(count(*))), 6) as cp_max_stat from bs group by doc_id")
def q_cp_feature(spark, sf_dir):
    return W.change_point_feature(_sents(spark, sf_dir))


@query("q_changepoints")
def q_changepoints(spark, sf_dir):
    return W.change_points(_sents(spark, sf_dir))


_PAIRS = f"""{P.SENTS}, cw as (select doc_id, idx, word, count(*)::double as c from (select doc_id, idx, unnest(w) as word from s) where not list_contains([{', '.join(P.q(x) for x in L.FUNCTION)}], word) group by 1, 2, 3), nm as (select doc_id, idx, sqrt(sum(c * c)) as n from cw group by 1, 2),
dp as (select a.doc_id, a.idx as i, b.idx as j, sum(a.c * b.c) as dot from cw a join cw b on a.doc_id = b.doc_id and a.word = b.word and a.idx < b.idx group by 1, 2, 3), pr as (select dp.doc_id, i, j, dot / (x.n * y.n) as sim from dp join nm x on x.doc_id = dp.doc_id and x.idx = i join nm y on y.doc_id = dp.doc_id and y.idx = j)"""


@query("q_sent_similarity", f"with {_PAIRS} select doc_id, count(*) as n_pairs, round(max(sim), 6) as most, round(avg(sim), 6) as mean from pr group by doc_id")
def q_sent_similarity(spark, sf_dir):
    return W.sentence_pairs(_sents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.round(F.max("sim"), 6).alias("most"), F.round(F.avg("sim"), 6).alias("mean"))


@query("q_redundancy", f"""with {_PAIRS}, n as (select doc_id, count(*) as n from s group by 1 having count(*) >= 2), ad as (select s.doc_id, coalesce(sim, 0) as sim from s join n using (doc_id) left join pr on pr.doc_id = s.doc_id and i = s.idx and j = s.idx + 1 where s.idx < n - 1),
a as (select doc_id, avg(sim) as m, min(sim) as lo, stddev_pop(sim) as sd, avg(case when sim = 0 then 1.0 else 0.0 end) as jump from ad group by 1), f as (select doc_id, sum(sim) as s from pr where j - i >= 2 group by 1), x as (select n.doc_id, n, m, lo, sd, jump, coalesce(s, 0) / ((n - 1) * (n - 2) / 2) as mf from n join a using (doc_id) left join f using (doc_id))
select doc_id, round(m, 6) as sem_adj_mean, round(lo, 6) as sem_adj_min, case when n >= 3 then round(sd, 6) end as sem_adj_std, case when n >= 4 then round(mf, 6) end as sem_redundancy, case when n >= 4 then round(m - mf, 6) end as sem_local_gain, case when n >= 4 then round(jump, 6) end as sem_topic_jump_rate from x""")
def q_redundancy(spark, sf_dir):
    return W.coherence(_sents(spark, sf_dir))


_UNIT = f"""{P.SENTS}, cw as (select doc_id, idx, para, word, count(*)::double as c from (select doc_id, idx, para, unnest(w) as word from s) where not list_contains([{', '.join(P.q(x) for x in L.FUNCTION)}], word) group by 1, 2, 3, 4), nm as (select doc_id, idx, sqrt(sum(c * c)) as l from cw group by 1, 2), u as (select cw.doc_id, cw.idx, para, word, c / l as x from cw join nm on nm.doc_id = cw.doc_id and nm.idx = cw.idx), dn as (select doc_id, count(*) as n from s group by 1),
me as (select u.doc_id, word, sum(x) / any_value(n) as m from u join dn using (doc_id) group by 1, 2), to_ as (select doc_id, sum(m * m) as t from me group by 1), ds as (select u.doc_id, idx, sum(x * m) as d from u join me on me.doc_id = u.doc_id and me.word = u.word group by 1, 2),
cs as (select s.doc_id, coalesce(d / sqrt(t), 0) as v from s left join ds on ds.doc_id = s.doc_id and ds.idx = s.idx left join to_ on to_.doc_id = s.doc_id), ce as (select doc_id, avg(v) as m, stddev_pop(v) as sd from cs group by 1),
pn as (select doc_id, para, count(*) as n, row_number() over (partition by doc_id order by para) as k from s group by 1, 2), pm as (select u.doc_id, k, word, sum(x) / any_value(n) as g from u join pn on pn.doc_id = u.doc_id and pn.para = u.para group by 1, 2, 3), pl as (select doc_id, k, sum(g * g) as l from pm group by 1, 2),
pd as (select a.doc_id, a.k, sum(a.g * b.g) as d from pm a join pm b on a.doc_id = b.doc_id and a.word = b.word and b.k = a.k + 1 group by 1, 2), ps as (select a.doc_id, coalesce(d, 0) / sqrt(greatest(coalesce(x.l, 0), 1e-12) * greatest(coalesce(y.l, 0), 1e-12)) as v from pn a join pn b on b.doc_id = a.doc_id and b.k = a.k + 1 left join pd on pd.doc_id = a.doc_id and pd.k = a.k left join pl x on x.doc_id = a.doc_id and x.k = a.k left join pl y on y.doc_id = a.doc_id and y.k = a.k + 1), pa_ as (select doc_id, avg(v) as v from ps group by 1)"""


@query("q_sem_centroid", f"with {_UNIT} select dn.doc_id, case when n >= 3 then round(m, 6) end as sem_centroid_mean, case when n >= 3 then round(sd, 5) end as sem_centroid_std, round(v, 6) as par_sem_adjacent from dn left join ce using (doc_id) left join pa_ using (doc_id)")
def q_sem_centroid(spark, sf_dir):
    return W.centroids(_docs(spark, sf_dir)).drop("sem_compression")


@query("q_sem_compression")
def q_sem_compression(spark, sf_dir):
    return W.centroids(_docs(spark, sf_dir)).select("doc_id", "sem_compression")


_DIFF = f"""{P.SENTS}, c as (select doc_id, idx, len(w)::double as n, case when len(w) > 0 then len(list_distinct(w)) / len(w) end as ttr, [{_PUN}] as pun, [{_CLS}, len(w)] as cls, count(*) over (partition by doc_id) as total from s),
lr as (select a.doc_id, a.idx as b, {', '.join(f"[{', '.join(f'coalesce(sum(c.{col}[{i + 1}]) filter (where c.idx {op} a.idx), 0)::double' for i in range(size))}] as {col}{k}" for col, size in (('pun', len(PUNCTUATION)), ('cls', 7)) for k, op in ((0, '<'), (1, '>=')))}, avg(c.n) filter (where c.idx < a.idx) as n0, avg(c.n) filter (where c.idx >= a.idx) as n1, avg(c.ttr) filter (where c.idx < a.idx) as t0, avg(c.ttr) filter (where c.idx >= a.idx) as t1 from c a join c on c.doc_id = a.doc_id and c.idx between a.idx - 4 and a.idx + 3 where a.idx >= 3 and a.idx <= a.total - 3 group by 1, 2)"""


@query("q_boundary_differences", f"with {_DIFF} select doc_id, b, round(({_js('pun0', 'pun1')} + {_js('cls0', 'cls1')}) / 2, 6) as style_js, round(abs(n0 - n1), 6) as sentence_length, round(abs(t0 - t1), 6) as vocabulary from lr")
def q_boundary_differences(spark, sf_dir):
    return W.boundary_differences(_sents(spark, sf_dir))


@query("q_centroid", """with u as (select label, vec_id, list_transform(embedding, lambda v: v::double / sqrt(list_sum(list_transform(embedding, lambda z: z::double * z::double)))) as u from embeddings), p as (select label, vec_id, generate_subscripts(u, 1) as d, unnest(u) as x from u), c as (select label, d, avg(x) as c from p group by 1, 2), l as (select label, sqrt(sum(c * c)) as len from c group by 1),
s as (select p.label, vec_id, sum(x * c) / any_value(len) as s from p join c on c.label = p.label and c.d = p.d join l on l.label = p.label group by 1, 2) select label, round(avg(s), 4) as mean_sim, round(stddev_pop(s), 4) as std_sim, count(*) as n from s group by 1""")
def q_centroid(spark, sf_dir):
    return W.vector_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")


_SEG = "sg as (select id, generate_subscripts(segments, 1) as pos, unnest(segments) as sg from (select distinct id, segments from samples where id is not null and segments is not null))"


@query("q_range_segments", f"""with {_SEG}, g as (select id, pos, sg[1] as a, sg[2] as b, sg[3] as l from sg), t as (select id, any_value(text) as text from samples where id is not null and segments is not null group by id), sp as (select id, unnest(range(0, length(text) // 100 + 1)) as idx, length(text) as n from t),
x as (select id, idx, idx * 100 as st, least(idx * 100 + 100, n) as en from sp where idx * 100 < n) select x.id, x.idx, coalesce(arg_min(l, pos), 0) as seg_label from x left join g on g.id = x.id and (st + en) / 2 >= a and (st + en) / 2 < b group by 1, 2""")
def q_range_segments(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("id is not null and segments is not null").select("id", "text", "segments").dropDuplicates(["id"])
    n = F.length("text")
    spans = s.where(n > 0).select("id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 100).cast("int"))).alias("idx")).select("id", "idx", (F.col("idx") * 100).alias("start"), F.least(F.col("idx") * 100 + 100, F.col("n")).alias("end"))
    seg = s.select("id", F.posexplode("segments").alias("pos", "g")).select("id", "pos", F.col("g")[0].alias("seg_start"), F.col("g")[1].alias("seg_end"), F.col("g")[2].alias("seg_label"))
    return W.segment_labels(spans, seg)


@query("q_band_match", f"""with {_SEG}, t as (select distinct id, (sg[1] // 60)::int as b from sg where pos > 1), f as (select distinct id, (sg[2] // 60)::int as b from sg) select t.id, count(distinct t.b) as n_true, count(distinct t.b) filter (where exists (select 1 from f where f.id = t.id and abs(f.b - t.b) <= 2)) as n_near from t group by t.id""")
def q_band_match(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("id is not null and segments is not null").select("id", "segments").distinct()
    g = s.select("id", F.posexplode("segments").alias("pos", "g"))
    t = g.where("pos > 0").select("id", F.floor(F.col("g")[0] / 60).cast("int").alias("b")).distinct()
    f = g.select("id", F.floor(F.col("g")[1] / 60).cast("int").alias("c")).distinct()
    near = t.join(f, "id").where("abs(c - b) <= 2").select("id", "b").distinct().withColumn("near", F.lit(1))
    return t.join(near, ["id", "b"], "left").groupBy("id").agg(F.count("*").alias("n_true"), F.count("near").alias("n_near"))


@query("q_greedy_match", f"""with recursive {_SEG}, t as (select id, list(distinct (sg[1] // 60)::int order by (sg[1] // 60)::int) as t from sg where pos > 1 group by 1), f as (select id, list(distinct (sg[2] // 60)::int order by (sg[2] // 60)::int) as f from sg group by 1),
b as (select coalesce(t.id, f.id) as id, coalesce(t, []::int[]) as t, coalesce(f, []::int[]) as f from t full join f on t.id = f.id),
st as (select id, 0 as i, t as free, 0 as k from b union all select id, i + 1, case when h is null then free else list_filter(free, lambda v: v <> h) end, k + case when h is null then 0 else 1 end from (select st.*, list_filter(free, lambda v: abs(v - f[i + 1]) <= 2)[1] as h from st join b using (id) where i < len(f)))
select b.id, len(t)::int as n_true, len(f)::int as n_found, k as n_matched from b join st on st.id = b.id and st.i = len(f)""")
def q_greedy_match(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("id is not null and segments is not null").select("id", "segments").distinct()
    g = s.select("id", F.posexplode("segments").alias("pos", "g"))
    t, f = g.where("pos > 0").select("id", F.floor(F.col("g")[0] / 60).cast("int").alias("b")), g.select("id", F.floor(F.col("g")[1] / 60).cast("int").alias("b"))
    return W.match_boundaries(t, f)


# --- overlap of samples with the reference library ---------------------------

def _lib(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("id is not null and text is not null").select("id", "text").dropDuplicates(["id"])
    return s, table(spark, sf_dir, "reference_docs").select(F.col("id").alias("ref_id"), "text")


def _md5(gram):
    return F.conv(F.substring(F.md5(gram), 1, 15), 16, 10).cast("long")


_LIB = f"""ls as (select id as key, {P.words('any_value(text)')} as w from samples where id is not null and text is not null group by id), lr as (select id as key, {P.words('text')} as w from reference_docs where id is not null and text is not null)"""


def _grams(name: str, source: str, n: int) -> str:
    return f"{name} as (select key, i - 1 as pos, array_to_string(w[i:i + {n - 1}], ' ') as g from (select key, w, unnest(range(1, len(w) - {n - 2})) as i from {source} where len(w) >= {n}))"


def _winnow(name: str, source: str, grams: str) -> str:
    h = "('0x' || substr(md5(g), 1, 15))::bigint"
    return f"""{name}h as (select key, pos, min({h}) over f as m, count(*) over f as k, count(*) over (partition by key) as n from {grams} window f as (partition by key order by pos rows between current row and 3 following)),
{name} as (select distinct key, m as h from {name}h where k = 4 or (n < 4 and pos = 0) union all select key, ('0x' || substr(md5(array_to_string(w, ' ')), 1, 15))::bigint from {source} where len(w) between 1 and 4)"""


_PRINTS = f"{_LIB}, {_grams('gs', 'ls', 5)}, {_grams('gr', 'lr', 5)}, {_winnow('fs', 'ls', 'gs')}, {_winnow('fr', 'lr', 'gr')}"
_CAND = f"{_PRINTS}, cd as (select fs.key as key, fr.key as ref, count(*) as shared from fs join fr using (h) group by 1, 2)"


@query("q_winnow", f"with {_PRINTS} select key, count(*) as n_prints, min(h) as least from fs group by key")
def q_winnow(spark, sf_dir):
    s, _ = _lib(spark, sf_dir)
    return M.winnow(s, "id", hashed=_md5).groupBy("key").agg(F.count("*").alias("n_prints"), F.min("h").alias("least"))


@query("q_winnow_crc32")
def q_winnow_crc32(spark, sf_dir):
    return M.winnow(_lib(spark, sf_dir)[1], "ref_id")


@query("q_candidates", f"with {_CAND} select key, ref, shared, rank from (select *, row_number() over (partition by key order by shared desc, ref) as rank from cd) where rank <= 20")
def q_candidates(spark, sf_dir):
    """A report of the best twenty."""
    s, r = _lib(spark, sf_dir)
    return M.candidates(M.tokens(s, "id"), M.tokens(r, "ref_id"))


@query("q_containment", f"with {_CAND}, tt as (select key, count(*) as n from gs group by 1), mi as (select key, g, count(*) as c from gs group by 1, 2), th as (select distinct key, g from gr), hh as (select cd.key, ref, sum(c) as k from cd join mi on mi.key = cd.key join th on th.key = ref and th.g = mi.g group by 1, 2) select cd.key, cd.ref, round(coalesce(k, 0) / n, 6) as containment5 from cd left join tt on tt.key = cd.key left join hh on hh.key = cd.key and hh.ref = cd.ref")
def q_containment(spark, sf_dir):
    s, r = _lib(spark, sf_dir)
    return M.contained(M.tokens(s, "id"), M.tokens(r, "ref_id"))


_RUNS = f"{_CAND}, ht as (select cd.key, ref, gs.pos as pa, gr.pos as pb from cd join gs on gs.key = cd.key join gr on gr.key = cd.ref and gr.g = gs.g), il as (select *, pa - row_number() over (partition by key, ref, pa - pb order by pa) as island from ht), rn as (select key, ref, min(pa) as start, min(pb) as ref_start, count(*) + 4 as length from il group by key, ref, pa - pb, island having count(*) + 4 >= 8)"


@query("q_exact_runs", f"with {_RUNS} select * from rn")
def q_exact_runs(spark, sf_dir):
    s, r = _lib(spark, sf_dir)
    return M.exact_runs(M.tokens(s, "id"), M.tokens(r, "ref_id"))


@query("q_coverage", f"with {_RUNS}, ex as (select distinct key, unnest(range(start, start + length)) as p from rn), ec as (select key, count(*) as k from ex group by 1) select ls.key, round(coalesce(k, 0) / len(w), 6) as covered from ls left join ec using (key) where len(w) > 0")
def q_coverage(spark, sf_dir):
    s, r = _lib(spark, sf_dir)
    return M.coverage(M.tokens(s, "id"), M.tokens(r, "ref_id"))


@query("q_tfidf_cosine", f"""with {_CAND}, lc as (select key, t, count(*)::double as c from (select key, unnest(w) as t from ls) group by 1, 2), rc as (select key, t, count(*)::double as d from (select key, unnest(w) as t from lr) group by 1, 2),
x as (select cd.key, cd.ref, t, c, null::double as d from cd join lc on lc.key = cd.key union all select cd.key, cd.ref, t, null, d from cd join rc on rc.key = cd.ref), y as (select key, ref, t, max(c) as c, max(d) as d from x group by 1, 2, 3), v as (select *, case when c is null or d is null then ln(1.5) + 1 else 1 end as idf from y)
select key, ref, round(coalesce(sum(c * d * idf * idf), 0) / sqrt(sum(c * c * idf * idf) * sum(d * d * idf * idf)), 6) as cosine from v group by 1, 2""")
def q_tfidf_cosine(spark, sf_dir):
    s, r = _lib(spark, sf_dir)
    return M.cosines(M.tokens(s, "id"), M.tokens(r, "ref_id"))


def _sentences_sql(name: str, source: str) -> str:
    """Sentences of whole texts, by marks alone."""
    return f"{name} as (select key, generate_subscripts(ss, 1) - 1 as idx, unnest(ss) as s from (select key, {P.sentences('text')} as ss from {source}))"


_MATCH = f"""{_CAND}, top as (select key, ref from (select *, row_number() over (partition by key order by shared desc, ref) as rank from cd) where rank <= 10), ta as (select id as key, any_value(text) as text from samples where id is not null and text is not null group by id), tb as (select id as key, text from reference_docs where id is not null and text is not null), {_sentences_sql('sa', 'ta')}, {_sentences_sql('sb', 'tb')},
wa as (select key, idx, word, count(*)::double as c from (select key, idx, unnest({P.words('s')}) as word from sa) group by 1, 2, 3), wb as (select key, idx, word, count(*)::double as c from (select key, idx, unnest({P.words('s')}) as word from sb) group by 1, 2, 3), na as (select key, idx, sqrt(sum(c * c)) as n from wa group by 1, 2), nb as (select key, idx, sqrt(sum(c * c)) as n from wb group by 1, 2),
dt as (select top.key, ref, wa.idx as i, wb.idx as j, sum(wa.c * wb.c) as d from top join wa on wa.key = top.key join wb on wb.key = top.ref and wb.word = wa.word group by 1, 2, 3, 4), sm_ as (select dt.*, round(d / (na.n * nb.n), 6) as similarity from dt join na on na.key = dt.key and na.idx = i join nb on nb.key = dt.ref and nb.idx = j)"""


@query("q_sentence_matches", f"with {_MATCH} select key, ref, i, j, similarity from (select *, row_number() over (partition by key, ref, i order by similarity desc, j) as rn from sm_ where similarity >= 0.8) where rn = 1")
def q_sentence_matches(spark, sf_dir):
    """Of each text and the ten references that share most fingerprints with it, as a report gives them."""
    s, r = _lib(spark, sf_dir)
    split = lambda t, k: t.where(F.col(k).isNotNull() & F.col("text").isNotNull()).select(F.col(k).alias("key"), T.words(F.col("text")).alias("w"), F.transform(T.sentences(F.col("text")), T.words).alias("parts"))
    return M.best_sentences(split(s, "id"), split(r, "ref_id"))


@query("q_similarity_report", f"""with {_RUNS}, tt as (select key, count(*) as n from gs group by 1), mi as (select key, g, count(*) as c from gs group by 1, 2), th as (select distinct key, g from gr), hh as (select cd.key, ref, sum(c) as k from cd join mi on mi.key = cd.key join th on th.key = ref and th.g = mi.g group by 1, 2),
lg as (select key, ref, max(length) as longest from rn group by 1, 2), wd as (select key, ref, count(distinct p) as words from (select key, ref, unnest(range(start, start + length)) as p from rn) group by 1, 2),
sx as (select cd.key, cd.ref, shared, round(coalesce(k, 0) / n, 6) as containment5, coalesce(longest, 0)::bigint as longest, coalesce(words, 0)::bigint as words, len(w) as size from cd join ls on ls.key = cd.key left join tt on tt.key = cd.key left join hh on hh.key = cd.key and hh.ref = cd.ref left join lg on lg.key = cd.key and lg.ref = cd.ref left join wd on wd.key = cd.key and wd.ref = cd.ref),
sy as (select *, round(greatest(coalesce(containment5, 0), words / greatest(size, 1)), 6) as score from sx) select key, ref, shared, containment5, longest, words, score from (select *, row_number() over (partition by key order by score desc, shared desc, ref) as rank from sy) where rank <= 10""")
def q_similarity_report(spark, sf_dir):
    """A report of the best ten of all references that share a fingerprint."""
    s, r = _lib(spark, sf_dir)
    return M.similarity_report(s, "id", r, "ref_id")

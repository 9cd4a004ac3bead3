"""SQL counterparts of the text expressions, for the checks in DuckDB."""

from __future__ import annotations

from textloom.functions.text import ACCENTED, PLAIN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"translate(lower({x}), {q(ACCENTED)}, {q(PLAIN)})"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, {q(chr(92) + 'p{L}+(?:' + chr(39) + chr(92) + 'p{L}+)?')})"


def _kept(parts: str, strip: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {strip}), lambda s: length(s) > 0)"


def sentences(x: str) -> str:
    marked = f"""regexp_replace({x}, '([.!?])["''\\)\\]]?\\s+(["''\\(\\[]?[A-Z0-9Α-Ω])', '\\1' || chr(1) || '\\2', 'g')"""
    return _kept(f"string_split({marked}, chr(1))", "trim(s)")


def paragraphs(x: str) -> str:
    blank = r"\n[ \t]*\n"
    return f"case when regexp_matches({x}, '{blank}') then " + _kept(f"regexp_split_to_array({x}, '{blank}')", r"regexp_replace(s, '^\s+|\s+$', '', 'g')") + " else " + _kept(f"regexp_split_to_array({x}, '\\n')", r"regexp_replace(s, '^\s+|\s+$', '', 'g')") + " end"


def is_heading(x: str) -> str:
    return f"""(not contains({x}, chr(10)) and len({words(x)}) <= 10 and not regexp_matches({x}, '[.!?:;…]["''\\)\\]»”]*$'))"""


DOCS = "d as (select doc_id, text, lang, source, domain, label, n_chars from documents where doc_id is not null and text is not null)"
#: paragraphs (idx from 0), sentences of paragraphs that are no headings (idx from 0 over the document), words (pos from 0)
PARAS = f"{DOCS}, pa as (select doc_id, generate_subscripts(ps, 1) - 1 as para, unnest(ps) as p from (select doc_id, {paragraphs('text')} as ps from d))"
SENTS = f"""{PARAS}, body as (select *, {is_heading('p')} as h from pa), kept as (select * from (select *, bool_and(h) over (partition by doc_id) as all_h from body) where all_h or not h),
s0 as (select doc_id, para, generate_subscripts(ss, 1) as k, unnest(ss) as s from (select doc_id, para, {sentences('p')} as ss from kept)),
s as (select doc_id, para, row_number() over (partition by doc_id order by para, k) - 1 as idx, s, {words('s')} as w from s0)"""
WORDS = f"{SENTS}, wd as (select doc_id, para, idx, generate_subscripts(w, 1) - 1 as k, unnest(w) as word from s), w as (select doc_id, para, idx, k, word, row_number() over (partition by doc_id order by idx, k) - 1 as pos from wd)"

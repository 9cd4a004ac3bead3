"""Text expressions: all built-in columns, no Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented small letters and their plain forms, Latin and Greek.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżžάέήίόύώϊϋΐΰς’"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzzαεηιουωιυιυσ'"
#: Word: letters, with one inner apostrophe.
WORD = r"\p{L}+(?:'\p{L}+)?"
#: Sentence boundary: a mark, at most one closer, space, and the start of the next sentence.
BOUNDARY = r"([.!?])[\"')\]]?\s+([\"'(\[]?[A-Z0-9Α-Ω])"
MARK = "\x01"
#: Characters left out, and quotes and spaces with their plain forms.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
MARKS = "\u2018\u2019\u201a\u201c\u201d\u201e\u00ab\u00bb\u00a0\u2009\u202f\u2002\u2003\u2007"
PLAIN_MARKS = "'" * 3 + '"' * 5 + " " * 6


def fold(text: Column) -> Column:
    """Small letters without accents; final sigma and curly apostrophe plain."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def words(text: Column) -> Column:
    """The folded words in order."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences of a paragraph in order."""
    parts = F.split(F.regexp_replace(text, BOUNDARY, f"$1{MARK}$2"), MARK)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def paragraphs(text: Column) -> Column:
    """Split at blank lines if there are any, else at line ends; trimmed, non-empty."""
    blank = text.rlike(r"\n[ \t]*\n")
    parts = F.when(blank, F.split(text, r"\n[ \t]*\n")).otherwise(F.split(text, r"\n"))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 0)


def is_heading(paragraph: Column, most_words: int = 10) -> Column:
    """A single line of at most ten words without a final mark."""
    return ~paragraph.contains("\n") & (count_words(paragraph) <= most_words) & ~paragraph.rlike(r"[.!?:;…][\"')\]»”]*$")


def end_mark(sentence: Column) -> Column:
    """period, question, exclaim, ellipsis or none, by the last mark before closers."""
    m = F.regexp_extract(sentence, r"(\.\.\.|…|[.?!;])[\"')\]»”]*$", 1)
    return F.when(m.isin("...", "…"), "ellipsis").when(m == "?", "question").when(m == "!", "exclaim").when(m == ".", "period").otherwise("none")


def sentence_count_quick(text: Column) -> Column:
    """At least 1; otherwise the runs of marks before a space or the end."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit(r"[.!?]+(?:\s|$)"), F.lit(0))))


def trim_incomplete_tail(text: Column) -> Column:
    """Without the last fragment where the text doesn't end with a mark; unchanged where no sentence ends before it."""
    stripped = F.regexp_replace(text, r"\s+$", "")
    whole = stripped.rlike(r"[.!?][\"')\]]?$")
    head = F.regexp_extract(stripped, r"(?s)^(.*[.!?][\"')\]]?)\s", 1)
    return F.when(whole | (head == ""), stripped).otherwise(head)


def excerpt(text: Column, k: int) -> Column:
    """The first k words between spaces."""
    return F.array_join(F.slice(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), 1, k), " ")


def strip_labels(text: Column) -> Column:
    """Without up to three leading blank or label lines such as ``Prompt: ...``."""
    return F.regexp_replace(text, r"^(?:[ \t]*\n|[ \t]*(?i:prompt|title|essay|answer|response|text|output|question|abstract|story) ?:[^\n]*\n){1,3}", "")


def normalize(text: Column) -> Column:
    """Newlines, invisible characters, quotes, spaces, dashes, stray separators, list marks and blank runs in one form.

    HTML entities and composed characters are ``normalize_unicode``'s part.
    """
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.translate(t, INVISIBLE, "")
    t = F.translate(t, MARKS, PLAIN_MARKS)
    t = F.regexp_replace(t, r"(\d)[‐-–](\d)", "$1-$2")
    t = F.regexp_replace(t, r"[ \t]*(?:—|–|--)[ \t]*", " — ")
    # separators left where list headings were taken out
    t = F.regexp_replace(t, r"(?m)^[ ,;]+", "")
    t = F.regexp_replace(t, r"([.!?])[;,]+(\s|$)", "$1$2")
    t = F.regexp_replace(t, r",(?:\s*,)+", ",")
    t = F.regexp_replace(t, r" +([,;:])", "$1")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[•●▪*][ \t]+", "- ")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def unwrap(block: Column) -> Column:
    """A block with hard wraps joined.

    At least three lines, a median length of all but the last of 50 to 100,
    and half of those lines without a final mark: one line.  Else only lines
    that begin with a small letter or digit are joined to the one before.
    """
    lines = F.split(block, "\n")
    n = F.size(lines)
    head = F.slice(lines, 1, F.greatest(n - 1, F.lit(1)))
    lengths = F.array_sort(F.transform(head, lambda x: F.length(x)))
    m = F.size(lengths)
    median = (F.element_at(lengths, F.floor((m + 1) / 2).cast("int")) + F.element_at(lengths, (F.floor(m / 2) + 1).cast("int"))) / 2
    open_lines = F.size(F.filter(head, lambda x: ~x.rlike(r"[.!?:;][\"')\]]?\s*$")))
    wrapped = (n >= 3) & median.between(50, 100) & (open_lines * 2 >= F.size(head))
    return F.when(wrapped, F.regexp_replace(block, r"\s*\n\s*", " ")).otherwise(F.regexp_replace(block, r"[ \t]*\n[ \t]*([\p{Ll}\d])", " $1"))


def lexicon_count(tokens: Column, lexicon: list[str]) -> Column:
    """How many tokens are in a list of folded words."""
    known = F.array(*[F.lit(x) for x in sorted(set(lexicon))])
    return F.size(F.filter(tokens, lambda w: F.array_contains(known, w)))


def hybrid_class(share: Column) -> Column:
    """0 to 3 by machine share, at 0.15, 0.5 and 0.85, each bound in the upper class."""
    return F.when(share < 0.15, 0).when(share < 0.5, 1).when(share < 0.85, 2).when(share.isNotNull(), 3)

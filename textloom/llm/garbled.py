"""Text decoded with the wrong character encoding (problem 9).

Round-trip repair: the text is encoded again under a candidate legacy
encoding and strictly decoded as the intended one; a step is taken when a
garbling cost drops, and steps repeat for nested layers.  The whole text is
tried first, then its parts, for texts that are garbled only in places:
UTF-8 byte sequences wherever they stand, and words for one-byte encodings.
Garbled characters written as character references ("&#195;&#169;") are read
first.  Bytes that became replacement characters or question marks are lost:
they tell the document, and nothing can be restored there.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 text was read as, in the order tried on equal cost.
LEGACY = ("cp1252", "latin-1", "cp1253", "iso8859_7", "mac_roman", "cp437", "cp850", "cp737", "mac_greek", "cp1250", "cp1251", "iso8859_15")
#: One-byte encodings: (read as, intended).
ONE_BYTE = (("cp1252", "cp1253"), ("latin-1", "iso8859_7"), ("cp1253", "cp1252"), ("iso8859_7", "latin-1"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1253"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1251", "cp1253"))
MOST_LAYERS = 6
#: Share of the cost that a step back to UTF-8 takes away at least.
LEAST_DROP = 0.2

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿŒœŠšŽžŸŁłẞ"
_GREEK = "Ͱ-Ͽἀ-῿"
#: What a decoded character may be: Latin and Greek letters, typographic marks, currency, signs, emoji.
_PLAUSIBLE = re.compile(r"[ƒˆ˜ -ÿŒœŠšŽžŸŁłẞΆ-ώ‐-―‘-„†-…‰′″‹›€™←-⇿−​-‍﻿☀-➿\U0001f300-\U0001faff]")
_LEAD = re.compile(r"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}")

_COSTS = (
    # control characters and replacement characters are never right
    (3, re.compile("[\x80-\x9f�]")),
    # a letter that leads byte sequences, with a sign no word has inside
    (2, re.compile(r"[ÂÃÎÏÐÑÅÄâãîïÌÍËÊΓΞΟβΒ╬╧├┬√‚Œœ¬][\u0080-¿ˆ˜€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ΄΅Ά±≥≤∑∏∫ªº∂∆◊√≈Äåäàâùôêëïîñóöúß─-▟⌐⌠⌡]")),
    # scripts mixed inside a word
    (2, re.compile(rf"[{_LATIN}][{_GREEK}]|[{_GREEK}][{_LATIN}]")),
    # box drawing, mathematical and old keyboard signs against a word
    (2, re.compile(r"[─-▟∂√∫≈≠≤≥∑∏∞◊⌐¬░▒▓][^\s]|[^\s][─-▟∂√∫≈≠≤≥∑∏∞◊⌐░▒▓]")),
    # words of accented letters alone
    (1, re.compile(r"(?<![A-Za-z])[¢-¿À-ÖØ-öø-ÿ]{3,}(?![A-Za-z])")),
    (1, re.compile(r"[À-ÖØ-öø-ÿ]{4,}")),
    # a capital with an accent after a small letter
    (1, re.compile(r"[a-zà-öø-ÿ][À-ÖØ-ÞŠŽ](?=[a-zà-öø-ÿ])")),
    # a sign in the middle of a word
    (1, re.compile(rf"[{_LATIN}{_GREEK}][¤¦§¨©ª¬®¯±²³¶·¸¹º¼½¾‡†‰ˆ˜™][{_LATIN}{_GREEK}]")),
    (1, re.compile(rf"(?:^|\s)[΄΅][{_LATIN}{_GREEK}]")),
)


_LETTER = r"[^\W\d_]"
#: Question marks where characters were lost: two and more before a letter, between words, or behind a comma; runs next to runs.
_LOST = re.compile(rf"\?{{2,}}(?={_LETTER})|(?<=[,;:.])\?{{3,}}|(?<![^\s(\[])\?{{2,}}(?=[ \t](?:[^\W\dA-ZÀ-ÖØ-ÞΆ-Ϋ_]|\d))|\?{{3,}}[ \t]\?{{2,}}|\?{{7,}}")
#: One question mark between letters: a lost letter, but not where an address has its query.
_LOST_LETTER = re.compile(rf"(?<!\S)[^\s/=&:.?]*{_LETTER}\?{_LETTER}[^\s/=&:?]*(?!\S)")
_REFERENCE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,31}\d{0,2});")
#: What a document without any of these can't be: not ASCII, a reference, lost letters. For Java's matcher.
TRACES = r"[^\x00-\x7f]|&#?[0-9A-Za-z]{2,32};|\?\?|\p{L}\?\p{L}"


def lost_characters(text: str) -> int:
    """How many traces of characters lost to replacement, control or question marks a text has."""
    n = sum("\x80" <= c <= "\x9f" or c == "\ufffd" for c in text) if not text.isascii() else 0
    if "?" in text:
        n += sum(1 for _ in _LOST.finditer(text)) + sum(1 for _ in _LOST_LETTER.finditer(text))
    return n


def _read_reference(m: re.Match[str]) -> str:
    ch = html.unescape(m.group())
    return m.group() if ch.isascii() else ch


def read_references(text: str) -> str:
    """Character references to other than ASCII as the characters they name; markup stays."""
    return _REFERENCE.sub(_read_reference, text) if "&" in text else text


def garbling_cost(text: str) -> int:
    """How much of a text looks like the trace of a wrong decoding; 0 for right text."""
    return sum(w * sum(1 for _ in p.finditer(text)) for w, p in _COSTS)


def _byte_table(name: str) -> dict[int, int]:
    """Code point to byte. Bytes without a character stand for themselves, as lenient decoders leave them."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


_BYTES = {name: _byte_table(name) for name in {*LEGACY, *(w for pair in ONE_BYTE for w in pair)}}


def _encoded(text: str, name: str) -> bytes | None:
    table, out = _BYTES[name], bytearray()
    for ch in text:
        b = ord(ch)
        if b > 127:
            b = table.get(b, -1)
            if b < 0:
                return None
        out.append(b)
    return bytes(out)


def _undo_utf8(text: str, name: str) -> tuple[str, int]:
    """Byte sequences of UTF-8 that were read as ``name``, decoded where that gives a plausible character; how many."""
    table = _BYTES[name]
    view = text.translate({c: table.get(c, 0xFFFF) for c in map(ord, set(text)) if c > 127})
    parts, last = [], 0
    for m in _LEAD.finditer(view):
        ch = m.group().encode("latin-1").decode("utf-8", "replace")
        if _PLAUSIBLE.match(ch) or "\x80" <= ch <= "\xff":
            parts += [text[last : m.start()], ch]
            last = m.end()
    return "".join([*parts, text[last:]]), len(parts) // 2


_WORD = re.compile(r"\S+")


def _undo_one_byte(text: str, name: str, right: str) -> str:
    """Words that one-byte reading garbled, and the short words between them."""

    def other(word: str) -> str:
        if word.isascii() or (raw := _encoded(word, name)) is None:
            return word
        try:
            return raw.decode(right)
        except UnicodeDecodeError:
            return word

    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    better = []
    for _, _, w in words:
        o = other(w) if not w.isascii() else w
        better.append((o, o != w and garbling_cost(o) < garbling_cost(w)))
    if not any(b for _, b in better):
        return text
    # short words cost nothing either way; they follow a garbled neighbour where they can be read in the script it gives
    sure = [b for _, b in better]
    for i, (o, b) in enumerate(better):
        if not b and o != words[i][2]:
            near = [k for k in range(max(0, i - 4), min(len(words), i + 5)) if sure[k]]
            if near and _same_script(o, better[near[0]][0]):
                better[i] = (o, True)
    parts, last = [], 0
    for (a, e, _), (o, b) in zip(words, better):
        if b:
            parts += [text[last:a], o]
            last = e
    return "".join([*parts, text[last:]])


def _same_script(a: str, b: str) -> bool:
    greek = re.compile(f"[{_GREEK}]")
    return bool(greek.search(a)) == bool(greek.search(b))


def _whole(text: str):
    for name in LEGACY:
        raw = _encoded(text, name)
        if raw is not None:
            try:
                yield 0, f"{name}>utf-8", raw.decode("utf-8")
            except UnicodeDecodeError:
                pass


def _in_parts(text: str):
    for name in LEGACY:
        part, n = _undo_utf8(text, name)
        if n:
            yield -n, f"{name}>utf-8, parts", part


def _by_word(text: str):
    for name, right in ONE_BYTE:
        part = _undo_one_byte(text, name, right)
        if part != text:
            yield 0, f"{name}>{right}", part


def repair(text: str) -> tuple[str, list[str], int]:
    """(best text, steps taken, garbling cost left).

    Of the steps that lower the cost, one over the whole text comes first (it
    hardly decodes by chance), then the one that undoes the most sequences,
    then the one-byte encoding that leaves the least cost.
    """
    cost, taken = garbling_cost(text), []
    if (read := read_references(text)) != text and (c := garbling_cost(read)) > cost:
        # references are part of the garbling only where what they name is undone
        again = repair(read)
        if again[1]:
            return again[0], ["references", *again[1]], again[2]
    while cost and len(taken) < MOST_LAYERS:
        for kind in (_whole, _in_parts, _by_word):
            steps = [(rank, c, k, how, t) for k, (rank, how, t) in enumerate(kind(text)) if (c := garbling_cost(t)) < (cost if kind is _by_word else cost * (1 - LEAST_DROP))]
            if steps:
                _, cost, _, how, text = min(steps)
                taken.append(how)
                break
        else:
            break
    return text, taken, cost


def _stage(key: str):
    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(key), batch.column("text").to_pylist()):
                # what is left without a step counts only where characters were lost
                lost = lost_characters(t)
                if not lost and not garbling_cost(t) and "&" not in t:
                    continue
                fixed, steps, left = repair(t)
                if steps or lost:
                    lost = lost_characters(fixed)
                    rows.append((k.as_py(), fixed if steps else None, steps, left + lost == 0, left + lost))
            if rows:
                a, b, c, d, e = zip(*rows)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "restored": pa.array(b, pa.string()), "steps": pa.array(c, pa.list_(pa.string())), "complete": pa.array(d), "cost_left": pa.array(e, pa.int32())})

    return run


def garbled_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The affected documents and their text as far as it can be restored.

    Columns: doc_id, restored (null where nothing could be undone), steps
    (encodings undone, outermost first), complete (no trace is left),
    cost_left (its garbling cost and the characters lost in it).

    Null and empty texts and null ids are no cases; a row delivered twice
    counts once; extra columns are ignored.  References to rightly decoded
    characters, doubled question marks behind a word and addresses with a
    query are no cases.
    """
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("text")).where(F.col(key).isNotNull() & F.col("text").rlike(TRACES))
    return rows.mapInArrow(_stage(key), "doc_id long, restored string, steps array<string>, complete boolean, cost_left int").dropDuplicates(["doc_id"])

"""Texts cut off by field limits or in transfer (problem 1).

A text is cut where its last sentence has no end.  What shows it:

* a longer copy: the text is a strict prefix of another text whose last line
  goes on.  Hashes of prefixes of geometric lengths propose pairs, hashes of
  the whole shorter text decide them;
* the ending itself: a sentence that breaks off, or one that bears a mark put
  after it ("[...]", "(more)", an ellipsis).

A closing line that needs no final mark (list item, caption, place and date,
greeting, heading, credit) is told by its form, and only a longer copy shows
that it was cut.  So the verdict on a text depends on nothing but itself and
its longer copies, however many other rows are loaded.

A prefix that ends with a sentence is no evidence (a text shortened at a
sentence's end is whole), and most cut texts have no longer copy, so that
prefixes alone can't decide.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize

#: Decisions need no more than the last line and the one before; longer lines are open sentences anyway.
TAIL = 800
LONG_LINE = 60
#: Lengths at which prefixes are hashed; beyond the last one, texts are compared at the last and then in full.
PREFIX_LENGTHS = (16, 32) + tuple(int(64 * 2 ** (k / 2)) for k in range(0, 29))

#: Kinds of spaces made plain, and invisible characters left out.
_PLAIN = (("\u00a0", " "), ("\u202f", " "), ("\u2009", " "), ("\u200b", ""), ("\ufeff", ""), ("\u00ad", ""), ("\r", ""))
_CLOSERS = "[\"”»’')\\]]*"
_END = re.compile(rf"(?:[.!?…。]|[\u0370-\u03ff\u1f00-\u1fff\d][\"”»)]?;)\s?{_CLOSERS}$")
#: Marks that are put where a text was cut: short bracketed words or dots behind the last word.
_MARK = re.compile(r"(?:(?<=[^\n\s])[ \t]*[\[(<][^\[\]()<>\n]{1,24}[\])>]|\s?(?:…|\.{3,}))\s*$")
_INNER_END = re.compile(rf"(?:[^\W\d_]{{2}}|\d|[)»”\"%])\s?(?:[.!?…]|(?<=[\u0370-\u03ff\u1f00-\u1fff]);){_CLOSERS}\s+\S")
#: Closing lines by their form: list item or tag, numbered caption or heading, credit, date, count of parts, bracketed or smiling line, postscript.
_CLOSING = re.compile(r"^(?:[-–—*•#>].*|[^\W\d_]+\.? ?\d+ ?[:.\-–—].*|[^\W\d_]+ ?: \S.*|.*\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|[^\W\d_]+\.? \d+(?: [^\W\d_]+ | ?/ ?)\d+|[(\[].*[)\]]|.*[:;]-?[)D]|P\. ?S\..*)$")

#: Closing formulas as patterns of a whole line in small letters, by language (greeting, thanks, end of a part, heading of notes, note of an edit).
FORMULAS = {
    "en": (
        r"(?:(?:many|kind|kindest|best|warm|warmest|with|all|my|good|and|again) )*(?:thanks|thank you|regards|wishes|greetings|cheers|sincerely)(?: (?:again|so much|very much|a lot|in advance|for reading|for your (?:time|help|patience)|everyone|everybody|to all|all))*",
        r"yours(?: (?:truly|sincerely|faithfully|ever))?|(?:sincerely|faithfully|truly) yours|take care|see you(?: (?:soon|there|later))?|have a (?:nice|good|great) (?:day|week|weekend|one)|all the best|(?:with|much|lots of) love|(?:good|best of) luck|until next time|talk (?:to you )?soon",
        r"(?:i )?hope (?:that|this|it) helps?(?: .{1,20})?|to be continued|continued (?:below|overleaf|on page \d+)",
        r"(?:the )?end(?: of (?:the )?(?:(?:first|second|third|fourth|fifth|last|next) )?(?:part|chapter|section|story|book|volume|document|text|page))?(?: (?:one|two|three|four|five|\d+))?",
        r"(?:(?:further|selected|suggested) )?(?:notes?|sources?|references?|bibliography|footnotes?|endnotes?|acknowledge?ments?|appendix|appendices|contents|index|credits|glossary|summary|conclusions?|reading|see also)(?: (?:and|&) (?:notes?|sources?|references?|bibliography|acknowledge?ments?|credits|links?|further reading))?",
        r"(?:last|first|originally) (?:edited|updated|modified|changed|revised|reviewed|published|posted|printed)(?: (?:on|in|at|by|from) .{1,40})?|(?:edited|updated|modified|revised|published|posted)(?: .{0,32}\d.{0,8})?",
    ),
    "el": (
        r"(?:με )?(?:(?:πολλούς|φιλικούς|θερμούς|εγκάρδιους|εκτίμηση και|πολλή|μεγάλη) )*(?:χαιρετισμούς|χαιρετισμοί|εκτίμηση|αγάπη|φιλικά|φιλιά|τιμή)|(?:σας |σε )?ευχαριστ(?:ώ|ούμε)(?: (?:πολύ|εκ των προτέρων|για όλα|για την ανάγνωση|και πάλι))*|καλή (?:συνέχεια|σας μέρα|μέρα|τύχη|εβδομάδα|αντάμωση)|τα λέμε(?: σύντομα)?|δικός σας|δική σας|ελπίζω να (?:βοηθάει|βοήθησα|βοηθά)",
        r"τέλος(?: του)?(?: (?:πρώτου|δεύτερου|τρίτου|τέταρτου|τελευταίου|\d+ου))?(?: (?:μέρους|κεφαλαίου|κειμένου|τόμου))?|συνεχίζεται",
        r"(?:σημειώσεις|σημείωση|πηγές|βιβλιογραφία|παραπομπές|ευχαριστίες|παράρτημα|περιεχόμενα|ευρετήριο|συμπεράσματα|περίληψη)(?: και (?:σημειώσεις|πηγές|βιβλιογραφία|παραπομπές|ευχαριστίες))?|τελευταία (?:ενημέρωση|επεξεργασία|αλλαγή|τροποποίηση)(?: .{1,40})?",
    ),
    "fr": (
        r"(?:(?:un|mille|grand|encore) )?merci(?: (?:beaucoup|bien|encore|d['’]avance|par avance|à tous|à toutes|pour tout|pour votre lecture|de votre lecture))*|(?:bien )?(?:cordialement|amicalement|affectueusement|sincèrement)|bien à (?:vous|toi|tous)|(?:(?:meilleures|sincères|cordiales) )?salutations(?: (?:distinguées|cordiales|amicales))?|à bientôt|bonne (?:journée|soirée|continuation|suite|lecture|chance)|amitiés|bises|en espérant que cela aide",
        r"(?:la )?fin(?: (?:de la|du)(?: (?:première|premier|deuxième|seconde|second|troisième|dernière|dernier))? (?:partie|chapitre|texte|récit|tome|livre|section))?|à suivre",
        r"(?:notes?|sources?|références?|bibliographie|remerciements|annexes?|sommaire|index|conclusions?|résumé|voir aussi|table des matières)(?: et (?:notes?|sources?|références?|bibliographie|remerciements))?|dernière (?:mise à jour|modification|révision)(?: .{1,40})?|(?:modifié|mis à jour|publié|revu)(?: .{0,32}\d.{0,8})?",
    ),
    "de": (
        r"(?:mit |und )?(?:(?:freundlichen|freundliche|herzlichen|herzliche|besten|beste|lieben|liebe|vielen|viele|schönen|schöne|sonnigen) )*(?:grüßen|grüße|grüssen|grüsse|gruß|gruss|wünschen|wünsche)|(?:(?:vielen|besten|herzlichen|schönen) )?(?:dank|danke)(?: (?:im voraus|schön|sehr|fürs lesen|für alles))*|hochachtungsvoll|bis (?:bald|dann|später|nächstes mal)|alles gute|viel (?:glück|erfolg|spaß)|ich hoffe,? das hilft",
        r"(?:das )?ende(?: (?:des|der)(?: (?:ersten|zweiten|dritten|vierten|letzten))? (?:teils|kapitels|abschnitts|textes|buches|bandes|geschichte))?|fortsetzung folgt",
        r"(?:anmerkungen|notizen|quellen|literatur|literaturverzeichnis|quellenangaben|danksagung|anhang|inhalt|inhaltsverzeichnis|zusammenfassung|fazit|siehe auch|fußnoten)(?: und (?:anmerkungen|notizen|quellen|literatur|danksagung))?|zuletzt (?:bearbeitet|geändert|aktualisiert)(?: .{1,40})?",
    ),
    "es": (
        r"(?:(?:un|mil|muchos|cordiales|atentos|con un) )*(?:cordial |atento )?(?:saludos?|abrazos?|besos?)(?: (?:cordiales|cordial|a todos|a todas|afectuosos?))*|(?:(?:muchas|mil|muchísimas) )?gracias(?: (?:de antemano|por todo|por leer|por adelantado|a todos|de nuevo))*|atentamente|cordialmente|hasta (?:pronto|luego|la próxima|otra)|buena suerte|espero que (?:ayude|sirva)",
        r"(?:el )?fin(?:al)?(?: (?:de la|del)(?: (?:primera|primer|segunda|segundo|tercera|tercer|última|último))? (?:parte|capítulo|texto|relato|tomo|libro|sección))?|continuará",
        r"(?:notas?|fuentes|referencias|bibliografía|agradecimientos|anexos?|índice|conclusiones|conclusión|resumen|véase también)(?: y (?:notas?|fuentes|referencias|bibliografía|agradecimientos))?|última (?:edición|actualización|modificación|revisión)(?: .{1,40})?|(?:editado|actualizado|modificado|publicado)(?: .{0,32}\d.{0,8})?",
    ),
    "it": (
        r"(?:(?:cordiali|distinti|tanti|cari|un|con i migliori) )*(?:saluti|saluto|abbraccio|abbracci|baci)(?: (?:a tutti|cordiali))*|(?:molte |tante |mille )?grazie(?: (?:mille|in anticipo|a tutti|di tutto|per la lettura|ancora|di cuore))*|cordialmente|cordialità|a presto|alla prossima|buona (?:giornata|serata|fortuna|continuazione|lettura)|spero (?:che )?(?:sia utile|aiuti|possa aiutare)",
        r"(?:la )?fine(?: (?:della|del)(?: (?:prima|primo|seconda|secondo|terza|terzo|ultima|ultimo))? (?:parte|capitolo|testo|racconto|tomo|libro|sezione))?|continua",
        r"(?:note|nota|fonti|riferimenti|bibliografia|ringraziamenti|appendice|indice|sommario|conclusioni|conclusione|vedi anche)(?: e (?:note|fonti|riferimenti|bibliografia|ringraziamenti))?|ultim[ao] (?:modifica|aggiornamento|revisione)(?: .{1,40})?|(?:modificato|aggiornato|pubblicato)(?: .{0,32}\d.{0,8})?",
    ),
}
_FORMULA = re.compile("(?:" + "|".join(p for patterns in FORMULAS.values() for p in patterns) + r")[,:]?")


def _unmarked(text: str) -> str:
    """A text without the marks that were put behind its last word."""
    for _ in range(3):
        if text[-1:] not in "])>….":  # no mark ends otherwise
            break
        end = text[-40:]  # marks are shorter
        if not (m := _MARK.search(end)):
            break
        text = text[: len(text) - len(end) + m.start()].rstrip()
    return text


def ending(text: str | None) -> tuple[str, bool]:
    """(state, marked) of a text or its tail.

    state: ``whole``, ``cut`` (its last sentence breaks off) or ``closing`` (a
    last line of its own without a final mark that has a closing line's form).
    A null text and one without letters or numbers is ``whole``: nothing shows
    a cut.
    """
    tail = text or ""
    for a, b in _PLAIN:
        tail = tail.replace(a, b)
    tail = tail.rstrip()
    base = _unmarked(tail)
    if base == tail and _END.search(base[-8:]) and tail[-1] not in ")]":
        return "whole", False
    *before, last = tail.split("\n")
    if before and re.match(r"\s*[(\[].*[)\]]$", last):  # a bracketed line of its own
        return "closing", False
    if not any(c.isalnum() for c in base) or _END.search(base[-8:]):
        return "whole", False
    if base != tail:
        return "cut", True
    line = last.strip()
    above = before[-1].strip() if before else ""
    wrapped = len(above) >= 30 and not _END.search(above[-8:]) and not _CLOSING.match(above)
    if len(line) >= LONG_LINE or _INNER_END.search(line) or wrapped:
        return "cut", False
    # "Fin" and "Nota" begin too many sentences
    formula = len(line) > 4 and _FORMULA.fullmatch(line.lower())
    return "closing" if formula or before and _CLOSING.match(line) else "cut", False


def _ending_stage(batches):
    for b in batches:
        tails = b.column("tail").to_pylist()
        state, marked = zip(*map(ending, tails)) if tails else ((), ())
        # characters of the mark, by which the text is longer than what was cut
        mark = [len(t.rstrip()) - len(_unmarked(t.rstrip())) if m else 0 for t, m in zip(tails, marked)]
        yield pa.RecordBatch.from_pydict({"key": b.column("key"), "state": pa.array(state, pa.string()), "marked": pa.array(marked, pa.bool_()), "mark": pa.array(mark, pa.int32())})


def endings(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state, marked, mark): how each text ends; see ``ending``. mark: characters of marks put behind it.

    A tail without any letter or number can't tell; there the whole text is read.
    """
    tail = F.right(F.rtrim(F.col(text)), F.lit(TAIL))
    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.when(tail.rlike(r"[\p{L}\p{N}]"), tail).otherwise(F.col(text)).alias("tail"))
    return rows.mapInArrow(_ending_stage, f"key {dict(records.dtypes)[key]}, state string, marked boolean, mark int")


def longer_copies(records: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """(key): the asked texts of at least sixteen characters that are strict prefixes of a longer text whose line goes on.

    asked: key, mark (characters to leave out at the end).  Prefixes of
    geometric lengths propose (longer text, length) pairs, as many as there are
    asked lengths and not asked texts, so that a hot beginning forms no pairs
    of records.  The whole shorter text decides, by its own 128-bit hash.
    """
    levels = F.array(*[F.lit(x) for x in PREFIX_LENGTHS])
    texts = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"))
    trimmed = F.regexp_replace("t", r"\s+$", "")
    mine = texts.join(asked.select("key", "mark").distinct(), "key").select("key", F.rtrim(F.left(trimmed, F.length(trimmed) - F.col("mark"))).alias("t")).withColumn("own", F.length("t"))
    mine = mine.withColumn("level", F.array_max(F.filter(levels, lambda x: x <= F.col("own")))).where("level is not null")
    mine = materialize(mine.select("key", "own", "level", F.xxhash64(F.left("t", F.col("level"))).alias("h"), F.md5("t").alias("whole")).distinct(), "open")
    wanted = mine.select("level", "h", "own").distinct()
    theirs = texts.select("t", F.xxhash64("t").alias("sig"), F.length("t").alias("n")).select("t", "sig", "n", F.explode(F.filter(levels, lambda x: x < F.col("n"))).alias("level")).select("sig", "n", "level", F.xxhash64(F.left("t", F.col("level"))).alias("h"))
    proposed = materialize(theirs.join(wanted, ["level", "h"]).where("n > own").select("sig", "own").distinct(), "proposed")
    # a copy goes on where more words of the same line follow, not only a mark
    goes_on = F.substr("t", F.col("own") + 1).rlike(r"^(?![ \t]*[\[(<])[^\n\r]*[\p{L}\p{N}]")
    met = texts.select("t", F.xxhash64("t").alias("sig")).join(proposed, "sig").where(goes_on).select("own", F.md5(F.left("t", F.col("own"))).alias("whole")).distinct()
    return mine.join(met, ["own", "whole"], "left_semi").select("key").distinct()


def cut_records(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, evidence) of the cut texts, one row a key.

    evidence: ``copy`` (a longer copy goes on), ``marked`` (a mark was put
    after the cut), ``open`` (the last sentence breaks off).  A closing line
    is cut only where a longer copy goes on.

    Null keys and texts, empty texts and repeated rows give no rows or one; a
    text delivered under one key in two forms has the evidence of either.
    """
    ends = materialize(endings(records, key, text).where("state <> 'whole'"), "endings")
    longer = longer_copies(records, key, text, ends).withColumn("longer", F.lit(True))
    told = ends.groupBy("key").agg(F.max(F.col("state") == "cut").alias("cut"), F.max("marked").alias("marked"))
    why = F.when(F.col("longer"), "copy").when(F.col("marked"), "marked").when(F.col("cut"), "open")
    return told.join(longer, "key", "left").select("key", why.alias("evidence")).where("evidence is not null")


def cut_rates(samples: DataFrame) -> DataFrame:
    """How often each source cuts: records, cut ones, their share, those a longer copy proves, those with a mark, and those whose n_words is above what is left.

    n_words is stale where the count was taken before the cut; a null or a
    right count says nothing.
    """
    rows = samples.where("id is not null").select("id", "source_dataset", "n_words", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("left_words")).dropDuplicates(["id"])
    cuts = cut_records(samples).withColumnRenamed("key", "id")
    rows = rows.join(cuts, "id", "left")
    is_cut = F.col("evidence").isNotNull()
    return rows.groupBy("source_dataset").agg(
        F.count("*").alias("n_samples"),
        F.count_if(is_cut).alias("n_cut"),
        F.round(F.count_if(is_cut) / F.count("*"), 6).alias("cut_share"),
        F.count_if(is_cut & (F.col("evidence") == "copy")).alias("n_longer_copy"),
        F.count_if(is_cut & (F.col("evidence") == "marked")).alias("n_marked"),
        F.count_if(is_cut & (F.col("n_words") > F.col("left_words") * 1.05)).alias("n_count_above"),
    )

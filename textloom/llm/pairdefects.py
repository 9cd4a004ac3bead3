"""Prompt and response pairs whose response does not answer (problem 3).

Response tokens are aligned with prompt tokens by the containment of shingles
and, where shingles meet, by the longest common subsequence: that finds
copies.  The sentences of a response are aligned with refusal templates in the
same way: shared pairs of words propose a template, the common subsequence
decides.  Languages are told by problem 5's model, fitted on labelled samples.
The ending decides cut answers, as for samples (``cutoff``); the finish word is
kept as evidence only.

Tokens, shingles and language scores are numpy arrays of a whole batch; only
pairs whose shingles meet are looked at one by one.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.langlabels import LANGUAGES
from textloom.functions.tokenarrays import TokenBatch, mix64, window_hashes
from textloom.llm.cutoff import cut_records
from textloom.llm.languages import LanguageSpec, WordScores, fit_languages

_U = np.uint64
_TOKEN = re.compile(r"[^\W_]+")
_TAGS = re.compile(r"<[^<>]{0,40}>|&[a-z]+;|```\w*")
#: What stands for an answer that was not given.
PLACEHOLDERS = frozenset("no output|empty|n a|na|none|null|nil|nan|blank|no text|no answer|no response|no content|no result|undefined|missing|placeholder|todo|tbd|output|text|response|answer|insert text here|your text here|lorem ipsum|error".split("|"))

#: Refusal templates, all lower case: every choice of one part from each place makes one; the number names the place that none may lack. They are aligned, not searched for.
TEMPLATES = (
    # en
    (1, ("i can t", "i cannot", "i m not able to", "i am not able to", "i m unable to", "i am unable to", "i won t", "i will not", "i must decline to", "i have to decline to", "i d rather not", "i would rather not", "i am not allowed to"), ("help with", "assist with", "comply with", "write", "rewrite", "continue", "translate", "produce", "provide", "create", "answer", "paraphrase", "edit", "discuss", "write about", "help with rewriting", "help with writing", "help with continuing", "help with translating"), ("this", "that")),
    (1, ("i won t be", "i will not be"), ("continuing", "writing", "rewriting", "translating", "producing", "providing", "answering", "paraphrasing", "editing"), ("this", "that")),
    (1, ("i do not feel comfortable", "i don t feel comfortable", "i m not comfortable", "i am not comfortable"), ("working on", "writing", "continuing", "rewriting", "translating", "with", "writing about"), ("this", "that")),
    (1, ("this", "that"), ("is something i must decline", "is something i have to decline", "is something i can t do", "is something i cannot do", "is something i m not able to do")),
    (0, ("i must decline", "i have to decline", "i need to decline"), ("this request", "that request", "this", "to do so")),
    (1, ("the request", "this request", "this"), ("falls outside what i am allowed to do", "falls outside what i m allowed to do", "goes beyond what i am allowed to do", "goes against my guidelines", "conflicts with my guidelines", "violates my guidelines")),
    # fr
    (1, ("je ne peux pas", "je ne peux", "je ne suis pas en mesure de", "il ne m est pas possible de", "il ne m est pas permis de", "il ne m est pas possible d", "il ne m est pas permis d", "je refuse de", "je ne souhaite pas"), ("reformuler", "écrire", "réécrire", "continuer", "poursuivre", "traduire", "rédiger", "produire", "vous aider avec", "répondre à", "paraphraser"), ("ce", "cette", "cela")),
    (0, ("je dois refuser", "je dois décliner", "je me dois de refuser"), ("cette demande", "cette requête", "de répondre", "de continuer")),
    # de
    (3, ("ich kann", "ich darf", "ich werde", "ich möchte"), ("diesen text", "diese passage", "diesen auszug", "diese anfrage", "dieses thema", "diese geschichte", "das"), ("nicht",), ("umschreiben", "schreiben", "fortsetzen", "weiterschreiben", "übersetzen", "beantworten", "bearbeiten", "verfassen", "fortführen")),
    (2, ("dabei", "damit", "hier", "hierbei"), ("kann ich nicht", "darf ich nicht", "kann ich leider nicht", "darf ich leider nicht"), ("helfen", "weiterhelfen", "behilflich sein")),
    (2, ("diesen text", "diese passage", "diesen auszug", "das"), ("kann ich nicht", "darf ich nicht"), ("umschreiben", "schreiben", "fortsetzen", "weiterschreiben", "übersetzen")),
    (2, ("ich muss", "ich möchte"), ("diese anfrage", "diese bitte", "das", "dies"), ("ablehnen",)),
    (3, ("es ist mir nicht",), ("möglich", "erlaubt", "gestattet"), ("diesen text zu", "diese passage zu", "das zu"), ("schreiben", "umschreiben", "übersetzen")),
    # es
    (1, ("no puedo", "no me está permitido", "no me es posible", "no soy capaz de", "no estoy autorizado a", "prefiero no"), ("reescribir", "escribir", "continuar", "seguir", "traducir", "redactar", "producir", "ayudar con", "responder a", "parafrasear"), ("este", "esta", "esto", "ese", "esa")),
    (0, ("debo rechazar", "tengo que rechazar", "debo declinar"), ("esta petición", "esta solicitud", "este encargo", "este pedido")),
    # it
    (1, ("non posso", "non mi è permesso", "non mi è possibile", "non sono in grado di", "non mi è consentito", "preferisco non"), ("riscrivere", "scrivere", "continuare", "proseguire", "tradurre", "redigere", "produrre", "aiutare con", "rispondere a", "parafrasare"), ("questo", "questa", "ciò")),
    (0, ("devo rifiutare", "devo declinare", "sono costretto a rifiutare"), ("questa richiesta", "questo incarico", "la richiesta")),
    # el
    (1, ("δεν μπορώ να", "δεν μου επιτρέπεται να", "δεν επιτρέπεται να", "αδυνατώ να", "δεν είμαι σε θέση να", "προτιμώ να μην"), ("γράψω", "συνεχίσω", "μεταφράσω", "ξαναγράψω", "αναδιατυπώσω", "παραφράσω", "βοηθήσω με", "απαντήσω σε", "διασκευάσω"), ("αυτό", "αυτή", "αυτόν")),
    (0, ("πρέπει να αρνηθώ", "οφείλω να αρνηθώ", "αναγκάζομαι να αρνηθώ"), ("αυτό το αίτημα", "το αίτημα", "αυτή την παράκληση")),
)
#: Tokens beside refusing sentences that leave it a refusal (an apology, an offer, a reason).
MOST_OTHER = 20
#: Tokens of an apology and a reason that a refusing sentence may hold besides the template.
MOST_BESIDE = 20
SHINGLE = 3
#: Nats by which another language than the wanted one must be the better one.
LEAST_MARGIN = 14.0


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one row of the table is one integer.

    What both begin and end with is common in any case and taken off first.
    """
    most, lo, hi = min(len(a), len(b)), 0, 0
    while lo < most and a[lo] == b[lo]:
        lo += 1
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    if lo + hi:
        return lo + hi + (lcs_length(a[lo : len(a) - hi], b[lo : len(b) - hi]) if lo + hi < most else 0)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = places.get(y, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class _Templates:
    """Templates as word lists, found by the pairs of words they hold."""

    def __init__(self) -> None:
        made = {tuple(" ".join(parts).split()): tuple(parts[key].split()) for key, *places in TEMPLATES for parts in itertools.product(*places)}
        self.words, self.keys = list(made), list(made.values())
        self.by_pair: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for pair in set(zip(w, w[1:])):
                self.by_pair[pair].append(i)
        pairs = TokenBatch([" ".join(p) for p in self.by_pair])
        self.hashes = np.sort(window_hashes(pairs, 2)[0])

    def aligned(self, sentence: list[str]) -> int:
        """Words of the best template that the sentence gives back, 0 for none.

        A template is asked where the sentence holds half of its word pairs,
        and given back where its words stand there in order, but for one in
        six, and never its telling place; of under six words none may lack.
        """
        hits: dict[int, int] = defaultdict(int)
        for pair in set(zip(sentence, sentence[1:])):
            for i in self.by_pair.get(pair, ()):
                hits[i] += 1
        best = 0
        for i, n in hits.items():
            w, key = self.words[i], self.keys[i]
            if len(w) > best and any(tuple(sentence[k : k + len(key)]) == key for k in range(len(sentence) - len(key) + 1)) and n >= 0.5 * (len(w) - 1) and lcs_length(list(w), sentence) >= len(w) - len(w) // 6:
                best = len(w)
        return best


_KNOWN = _Templates()
_SENTENCE = re.compile(r"(?<=[.!?;])[\"”»]?\s+|\n+")


def is_refusal(text: str, most_other: int = MOST_OTHER) -> bool:
    """Some sentence gives a refusal template back, and the others hold no answer."""
    other, refused = 0, False
    for sentence in _SENTENCE.split(text):
        w = _TOKEN.findall(sentence.lower())
        n = _KNOWN.aligned(w)
        refused |= n > 0
        other += max(0, len(w) - n - MOST_BESIDE) if n else len(w)
        if other > most_other:
            return False
    return refused


def aligned(source: list, answer: list, of_source: float = 0.85, of_answer: float = 0.7) -> bool:
    """The answer gives the source back whole: the common subsequence covers both."""
    if not source or not answer or len(source) * of_source > len(answer) or len(answer) * of_answer > len(source):
        return False
    least = max(of_source * len(source), of_answer * len(answer))
    # no more than what both have at all, in whatever order
    return sum((Counter(source) & Counter(answer)).values()) >= least and lcs_length(source, answer) >= least


def prompt_parts(prompt: str) -> tuple[str, str]:
    """(request, text): up to the first blank line, and what follows without a label line such as "Start:"."""
    request, _, body = prompt.partition("\n\n")
    first, _, rest = body.partition("\n")
    if rest and first.rstrip().endswith(":") and len(first) < 40:
        request, body = f"{request}\n{first}", rest
    return request, body


def _containment(source: TokenBatch, answer: TokenBatch) -> np.ndarray:
    """Share of each source's distinct shingles that its answer holds; 1 where the source is too short for any."""
    n = len(source)
    sets = []
    for batch in (source, answer):
        h, row = window_hashes(batch, SHINGLE)
        sets.append(np.unique(mix64(h ^ mix64(row.astype(np.uint64) + _U(1))), return_index=True) + (row,))
    (a, first, row), (b, _, _) = sets
    row = row[first]
    there = np.bincount(row, minlength=n)
    met = np.bincount(row[np.isin(a, b, assume_unique=True)], minlength=n)
    return np.where(there > 0, met / np.maximum(1, there), 1.0)


def _languages(batch: TokenBatch, scores: WordScores) -> np.ndarray:
    """Score of each language for each text."""
    words = scores.of(batch).astype(np.float64)
    total = np.concatenate([np.zeros((1, words.shape[1])), np.cumsum(words, axis=0)])
    return total[batch.offsets[1:]] - total[batch.offsets[:-1]]


def defects(tasks: list, prompts: list, texts: list, scores: WordScores | None) -> list[str | None]:
    """The first defect that holds for each pair, but for cut answers. Without scores, languages are not told."""
    plain = [_TAGS.sub(" ", t or "") if t and any(c in t for c in "<&`") else t or "" for t in texts]
    parts = [prompt_parts(p or "") for p in prompts]
    request, body, answer = TokenBatch([a for a, _ in parts]), TokenBatch([b for _, b in parts]), TokenBatch(plain)
    gives_body, gives_request = _containment(body, answer), _containment(request, answer)
    pair, row = window_hashes(answer, 2)
    hits = np.bincount(row[np.isin(pair, _KNOWN.hashes)], minlength=len(answer))
    given = wanted = None
    if scores is not None:
        given, wanted = _languages(answer, scores), _languages(body, scores)
    index = {k: i for i, k in enumerate(scores.spec.languages if scores is not None else LANGUAGES)}

    def one(i: int) -> str | None:
        own = answer.hashes[answer.offsets[i] : answer.offsets[i + 1]].tolist()
        if not own or (len(own) <= 4 and " ".join(answer.token(k) for k in range(answer.offsets[i], answer.offsets[i + 1])) in PLACEHOLDERS):
            return "empty"
        if hits[i] >= 2 and is_refusal(texts[i]):
            return "refusal"
        asked, source = (b.hashes[b.offsets[i] : b.offsets[i + 1]].tolist() for b in (request, body))
        if gives_body[i] >= 0.3:
            if asked and gives_request[i] >= 0.5 and lcs_length(asked, own) >= 0.8 * len(asked) and aligned(asked + source, own):
                return "copy"
            if tasks[i] != "polish" and aligned(source, own):
                return "copy"
        if scores is None:
            return None
        best = int(given[i].argmax())
        code = {"translate_el": "el", "write_el": "el", "backtranslate": "en"}.get(tasks[i] or "")
        if code in index:
            right = index[code]
        else:
            right = int(wanted[i].argmax())
            rest = np.delete(wanted[i], right)
            if not len(source) or wanted[i][right] - rest.max() < LEAST_MARGIN:
                return None
        return "wrong_language" if given[i][best] - given[i][right] >= LEAST_MARGIN else None

    return [one(i) for i in range(len(answer))]


def _stage(shared, spec: LanguageSpec):
    def run(batches):
        scores = WordScores(shared.value, spec)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                out = defects(b.column("task").to_pylist(), b.column("prompt").to_pylist(), b.column("text").to_pylist(), scores)
                yield pa.RecordBatch.from_pydict({"gen_id": b.column("gen_id"), "defect": pa.array(out, pa.string())})

    return run


def pair_defects(generations: DataFrame, labelled: DataFrame, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """(gen_id, defect), one row a defective pair.

    Columns read: gen_id, task, prompt, text; of ``labelled``, on which the
    language model is fitted (see ``fit_languages``), id, text, language.
    Without labelled rows no language is told wrong.  A null prompt leaves the
    defects that need none; a null task is taken as any task that keeps the
    language; null gen_ids give no rows; delivered copies count once.
    """
    shared = generations.sparkSession.sparkContext.broadcast(fit_languages(labelled, spec=spec))  # 2**bits x languages
    rows = generations.where("gen_id is not null").select("gen_id", "task", "prompt", "text")
    told = rows.mapInArrow(_stage(shared, spec), "gen_id long, defect string").dropDuplicates(["gen_id"])
    cuts = cut_records(generations, "gen_id", "text").select(F.col("key").alias("gen_id"), F.lit("truncated").alias("cut"))
    return told.join(cuts, "gen_id", "left").select("gen_id", F.coalesce("defect", "cut").alias("defect")).where("defect is not null")


def defect_rates(generations: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pairs and defects by task and generator family, and how often the finish word says so for cut answers."""
    rows = generations.where("gen_id is not null").select("gen_id", "task", "generator_family", F.lower("finish").alias("finish")).dropDuplicates(["gen_id"])
    rows = rows.join(pair_defects(generations, labelled), "gen_id", "left")
    kinds = [F.count_if(F.col("defect") == k).alias(f"n_{k}") for k in ("empty", "refusal", "copy", "wrong_language", "truncated")]
    said = F.count_if((F.col("defect") == "truncated") & F.col("finish").isin("length", "max_tokens")).alias("n_truncated_said")
    return rows.groupBy("task", "generator_family").agg(F.count("*").alias("n_pairs"), *kinds, said)

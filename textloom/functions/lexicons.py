"""Closed word classes and phrases, folded (small letters, no accents).

Fixed values that results depend on, in natural order.
"""

ARTICLES = "a an the".split()
PRON1S = "i me my mine myself".split()
PRON1P = "we us our ours ourselves".split()
PRON2 = "you your yours yourself yourselves".split()
PRON3 = "he him his himself she her hers herself it its itself they them their theirs themselves".split()
CCONJ = "and but or nor so yet".split()
SCONJ = "because although though while if unless since until when whereas whether after before that as".split()
PREPOSITIONS = "of in to for with on at by from about into over after under between through during against without within along across behind".split()
AUXILIARIES = "be am is are was were been being have has had do does did will would can could may might shall should must".split()
FUNCTION = sorted({*ARTICLES, *PRON1S, *PRON1P, *PRON2, *PRON3, *CCONJ, *SCONJ, *PREPOSITIONS, *AUXILIARIES, *"not no this these those there here what which who whom whose how why where some any each every all both few more most other such than too very just only own same then once".split()})

#: Transition phrases by category.
TRANSITIONS = {
    "additive": ["in addition", "furthermore", "moreover", "also", "equally", "additionally"],
    "adversative": ["however", "in contrast", "by comparison", "on the other hand", "nevertheless", "still", "although"],
    "causal": ["as a result", "as a consequence", "consequently", "therefore", "because", "thus"],
    "sequential": ["first", "second", "to begin with", "finally", "then", "next", "later"],
    "exemplifying": ["for example", "for instance", "such as", "in particular"],
    "summarising": ["in conclusion", "overall", "in essence", "ultimately", "in summary", "taken together"],
    "hedging": ["broadly speaking", "more importantly", "in practice", "notably", "anyway", "honestly", "to be fair"],
}
#: The same in Greek, folded.
GREEK_TRANSITIONS = {
    "additive": ["επιπλεον", "επισης", "επιπροσθετα", "εξαλλου", "παραλληλα", "ακομη"],
    "adversative": ["ωστοσο", "ομως", "αντιθετα", "εντουτοις", "παρολα αυτα", "απο την αλλη", "αλλα"],
    "causal": ["επομενωσ", "συνεπωσ", "αρα", "κατα συνεπεια", "ετσι", "γι αυτο"],
    "sequential": ["πρωτον", "δευτερον", "αρχικα", "επειτα", "στη συνεχεια", "κατοπιν", "τελικα"],
    "exemplifying": ["για παραδειγμα", "συγκεκριμενα", "ειδικοτερα"],
    "summarising": ["συμπερασματικα", "εν κατακλειδι", "συνολικα", "εν ολιγοισ", "συνοψιζοντασ"],
    "hedging": ["πραγματι", "μαλιστα", "προφανωσ", "σαφωσ", "ισωσ"],
}
for _k, _v in GREEK_TRANSITIONS.items():
    TRANSITIONS[_k] = TRANSITIONS[_k] + _v
#: Words that are transitions only where they begin a sentence.
INITIAL_ONLY = ["also", "still", "first", "second", "then", "next", "later", "thus", "because", "although", "ακομη", "ομως", "αλλα", "ετσι", "τελικα", "ισωσ"]
PHRASES = [(c, p) for c, ps in TRANSITIONS.items() for p in ps]

#: Contractions that casual rewriting puts for the long form: (pattern, short form).
CONTRACTIONS = [("do not", "don't"), ("does not", "doesn't"), ("did not", "didn't"), ("is not", "isn't"), ("are not", "aren't"), ("was not", "wasn't"), ("cannot", "can't"), ("will not", "won't"), ("would not", "wouldn't"), ("could not", "couldn't"), ("it is", "it's"), ("that is", "that's"), ("i am", "I'm"), ("i have", "I've"), ("we have", "we've"), ("they are", "they're")]

#: Domain to genre.
GENRES = {"essay": "student", "forum": "informal", "howto": "instructional", "review": "academic review", "abstract": "scientific", "story": "creative", "newswire": "news", "encyclopedia": "encyclopedic", "legal": "legal"}

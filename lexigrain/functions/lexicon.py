"""Closed classes of English grammar and the rules built on them, as SQL text that Spark and DuckDB both read.

Large lexicons (stop words, frequencies, synonyms, vectors, weights) are inputs
of the operators that use them, never constants here.
"""

from __future__ import annotations

# Closed sets whose members decide results.
PERSONAL = (
    "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "we us our ours ourselves they them their theirs themselves"
).split()
THIRD_PERSON = "he him his himself she her herself they them their themselves it its".split()
DEMONSTRATIVES = "this that these those".split()
ARTICLES = "a an the".split()
COORDINATORS = "and or but nor yet so for".split()
INDEFINITE = "something anything nothing everything someone anyone everyone noone somebody anybody nobody everybody".split()
WH_ADVERBS = "when where why how whenever wherever".split()
CONJUNCT_COORDINATORS = "yet so nor however therefore".split()

# Further closed classes of the rule tagger.
AUXILIARIES = "am are is was were be been being do does did have has had will would shall should can could may might must".split()
PREPOSITIONS = "of in to on at by with from into about over under between through during before after above below against among within without".split()
SUBORDINATORS = "if because although though while since unless until whereas whether as than".split()
ADVERBS = "not very too also then there here now never always often again still just even only soon ever".split()
NUMBERS = "one two three four five six seven eight nine ten hundred thousand million".split()
AUXILIARY_LEMMAS = {"am": "be", "are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "being": "be", "did": "do", "does": "do", "had": "have", "has": "have"}
PRONOUN_LEMMAS = {"me": "i", "him": "he", "us": "we", "them": "they", "hers": "her"}
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St vs etc".split()

CLASSES = ("all", "content", "function", "noun", "verb", "adj", "adv", "prp", "argument")


def quoted(words) -> str:
    """A list of SQL strings; the empty string, which is no word, for none."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words) or "''"


def _ends(x: str, *endings: str) -> str:
    return "(" + " OR ".join(f"{x} LIKE '%{e}'" for e in endings) + ")"


def word_class(w: str) -> str:
    """SQL: the coarse class of a lower-case word; closed classes first, then endings, then NOUN."""
    cases = [
        (f"{w} IN ({quoted(ARTICLES + DEMONSTRATIVES)})", "DET"),
        (f"{w} IN ({quoted(INDEFINITE)})", "NOUN"),
        (f"{w} IN ({quoted(PERSONAL)})", "PRON"),
        (f"{w} IN ({quoted(AUXILIARIES)})", "AUX"),
        (f"{w} IN ({quoted(COORDINATORS + SUBORDINATORS)})", "CONJ"),
        (f"{w} IN ({quoted(PREPOSITIONS)})", "ADP"),
        (f"{w} IN ({quoted(ADVERBS + WH_ADVERBS)})", "ADV"),
        (f"{w} IN ({quoted(NUMBERS)})", "NUM"),
        (f"length({w}) > 4 AND {_ends(w, 'ly')}", "ADV"),
        (f"length({w}) > 4 AND {_ends(w, 'ing', 'ed', 'ize', 'ise', 'ify')}", "VERB"),
        (f"length({w}) > 4 AND {_ends(w, 'ous', 'ful', 'ive', 'able', 'ible', 'al', 'ic', 'ish', 'less')}", "ADJ"),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN '{c}'" for test, c in cases) + " ELSE 'NOUN' END"


def lemma(w: str) -> str:
    """SQL: the lemma by rule; closed forms, then endings of the word's own class."""
    fixed = {**AUXILIARY_LEMMAS, **PRONOUN_LEMMAS}
    cases = [f"WHEN {w} = '{k}' THEN '{v}'" for k, v in fixed.items()]
    stem = lambda n: f"substr({w}, 1, length({w}) - {n})"
    c = word_class(w)
    cases += [
        f"WHEN length({w}) > 4 AND {_ends(w, 'ies')} AND {c} = 'NOUN' THEN {stem(3)} || 'y'",
        f"WHEN length({w}) > 4 AND {_ends(w, 'sses', 'xes', 'ches', 'shes')} AND {c} = 'NOUN' THEN {stem(2)}",
        f"WHEN length({w}) > 3 AND {_ends(w, 's')} AND NOT {_ends(w, 'ss', 'us', 'is')} AND {c} = 'NOUN' THEN {stem(1)}",
        f"WHEN length({w}) > 5 AND {_ends(w, 'ing')} THEN {stem(3)}",
        f"WHEN length({w}) > 4 AND {_ends(w, 'ed')} THEN {stem(2)}",
    ]
    return "CASE " + " ".join(cases) + f" ELSE {w} END"


def class_of(word: str) -> str:
    """The same rules as ``word_class``, for one word."""
    for words, c in _CLOSED:
        if word in words:
            return c
    if len(word) > 4:
        for endings, c in _OPEN:
            if word.endswith(endings):
                return c
    return "NOUN"


def lemma_of(word: str, c: str) -> str:
    """The same rules as ``lemma``, for one word of class c."""
    fixed = AUXILIARY_LEMMAS.get(word) or PRONOUN_LEMMAS.get(word)
    if fixed:
        return fixed
    if c == "NOUN":
        if len(word) > 4 and word.endswith("ies"):
            return word[:-3] + "y"
        if len(word) > 4 and word.endswith(("sses", "xes", "ches", "shes")):
            return word[:-2]
        if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
            return word[:-1]
    if len(word) > 5 and word.endswith("ing"):
        return word[:-3]
    if len(word) > 4 and word.endswith("ed"):
        return word[:-2]
    return word


_CLOSED = [
    (frozenset(ARTICLES + DEMONSTRATIVES), "DET"),
    (frozenset(INDEFINITE), "NOUN"),
    (frozenset(PERSONAL), "PRON"),
    (frozenset(AUXILIARIES), "AUX"),
    (frozenset(COORDINATORS + SUBORDINATORS), "CONJ"),
    (frozenset(PREPOSITIONS), "ADP"),
    (frozenset(ADVERBS + WH_ADVERBS), "ADV"),
    (frozenset(NUMBERS), "NUM"),
]
_OPEN = [
    (("ly",), "ADV"),
    (("ing", "ed", "ize", "ise", "ify"), "VERB"),
    (("ous", "ful", "ive", "able", "ible", "al", "ic", "ish", "less"), "ADJ"),
]


def member(name: str, w: str, c: str) -> str:
    """SQL: is a word w of class c in one of CLASSES?"""
    content = f"{c} IN ('NOUN', 'VERB', 'ADJ', 'ADV')"
    return {
        "all": "true",
        "content": content,
        "function": f"NOT ({content})",
        "noun": f"{c} = 'NOUN'",
        "verb": f"{c} = 'VERB'",
        "adj": f"{c} = 'ADJ'",
        "adv": f"{c} = 'ADV'",
        "prp": f"{w} IN ({quoted(PERSONAL)})",
        "argument": f"({c} = 'NOUN' OR {w} IN ({quoted(PERSONAL)}))",
    }[name]

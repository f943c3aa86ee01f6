"""Spanish stems by the published suffix rules (Snowball), as a function of a word and as a column."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouáéíóúü"
_PLAIN = str.maketrans("áéíóú", "aeiou")


def _by_length(suffixes) -> list[tuple[int, frozenset[str]]]:
    """The suffixes in sets of one length, the longest first."""
    return [(n, frozenset(s for s in suffixes if len(s) == n)) for n in sorted({len(s) for s in suffixes}, reverse=True)]


#: The suffixes of the published algorithm, step by step.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "iéndo ándo ár ér ír ando iendo ar er ir".split()
DELETED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AFTER_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
IDAD, IVO = "idad idades".split(), "iva ivo ivas ivos".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
GU_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
    "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó".split()
#: The same by length, as each step asks for them.
_PRONOUNS, _BEFORE_PRONOUN = _by_length(PRONOUNS), _by_length(BEFORE_PRONOUN)
_STANDARD = _by_length([*DELETED, *AFTER_IC, *REPLACED, "amente", "mente", *IDAD, *IVO])
_Y_VERBS, _VERBS, _RESIDUAL = _by_length(Y_VERBS), _by_length(GU_VERBS + VERBS), _by_length([*RESIDUAL, "e", "é"])
#: What suffixes end with; other words have none.
_ENDS = frozenset(s[-1] for by in (_PRONOUNS, _STANDARD, _Y_VERBS, _VERBS, _RESIDUAL) for _, those in by for s in those)


def _longest(word: str, suffixes: list[tuple[int, frozenset[str]]]) -> str:
    """The longest suffix that the word ends with, or nothing; one look at a set for each length."""
    for n, those in suffixes:
        if word[-n:] in those:
            return word[-n:]
    return ""


def _after_consonant(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    vowels = [c in VOWELS for c in word]
    if not vowels[1]:
        return next((i + 1 for i in range(2, len(word)) if vowels[i]), len(word))
    if vowels[0]:
        return next((i + 1 for i in range(2, len(word)) if not vowels[i]), len(word))
    return 3


def _without_pronoun(word: str, rv: int) -> str:
    pronoun = _longest(word, _PRONOUNS)
    if not pronoun or len(word) - len(pronoun) < rv:
        return word
    rest = word[: len(word) - len(pronoun)]
    verb = _longest(rest, _BEFORE_PRONOUN)
    if verb and len(rest) - len(verb) >= rv:
        return rest[: len(rest) - len(verb)] + verb.translate(_PLAIN)
    if rest.endswith("uyendo") and len(rest) - 5 >= rv:
        return rest
    return word


def _standard(word: str, r1: int, r2: int) -> str:
    """Without a standard suffix; the same word where there is none in its region."""
    suffix = _longest(word, _STANDARD)
    at = len(word) - len(suffix)
    if not suffix or at < (r1 if suffix == "amente" else r2):
        return word
    rest = word[:at]

    def less(*endings: str) -> str:
        found = max((e for e in endings if rest.endswith(e)), key=len, default="")
        return rest[: len(rest) - len(found)] if found and len(rest) - len(found) >= r2 else rest

    if suffix in REPLACED:
        return rest + REPLACED[suffix]
    if suffix in AFTER_IC:
        return less("ic")
    if suffix == "amente":
        shorter = less("iv", "os", "ic", "ad")
        if rest.endswith("iv") and shorter != rest and shorter.endswith("at") and len(shorter) - 2 >= r2:
            return shorter[:-2]
        return shorter
    if suffix == "mente":
        return less("ante", "able", "ible")
    if suffix in IDAD:
        return less("abil", "ic", "iv")
    if suffix in IVO:
        return less("at")
    return rest


def _without_verb(word: str, rv: int) -> str:
    region = word[rv:]
    suffix = _longest(region, _Y_VERBS)
    if suffix and word[: len(word) - len(suffix)].endswith("u"):
        return word[: len(word) - len(suffix)]
    suffix = _longest(region, _VERBS)
    rest = word[: len(word) - len(suffix)]
    return rest[:-1] if suffix in GU_VERBS and rest.endswith("gu") else rest


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other scripts lose only what looks like a suffix."""
    if word[-1:] not in _ENDS:
        return word.translate(_PLAIN)
    r1 = _after_consonant(word, 0)
    r2 = _after_consonant(word, r1)
    rv = _verb_region(word)
    word = _without_pronoun(word, rv)
    shorter = _standard(word, r1, r2)
    word = shorter if shorter != word else _without_verb(word, rv)
    suffix = _longest(word[rv:], _RESIDUAL)
    rest = word[: len(word) - len(suffix)]
    if suffix in ("e", "é") and rest.endswith("gu") and len(rest) - 1 >= rv:
        rest = rest[:-1]
    return rest.translate(_PLAIN)


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    """Stems of a column of words: each distinct word of a batch is worked on once."""
    return words.map({w: stem(w) for w in words.dropna().unique()})

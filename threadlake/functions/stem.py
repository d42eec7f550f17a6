"""Word analysis for search: tokens of any alphabet without accents, and Porter's stemmer."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

_TOKEN = re.compile(r"[^\W_]+")
_PLAIN = re.compile("[a-z0-9]+")

# The suffix rules of Porter's published algorithm (1980), in its order, with the two later changes (bli, logi).
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


_LETTERS = bytes(range(97, 123))
_VOWELS = bytes.maketrans(_LETTERS, bytes(118 if c in b"aeiou" else 99 for c in _LETTERS))


def _shape(word: str) -> bytes:
    """v or c for each letter; y is a vowel after a consonant. A beginning of the word has the same beginning of this."""
    if "y" not in word:
        return word.encode().translate(_VOWELS)
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out.encode()


def _measure(shape: bytes) -> int:
    """How often a run of vowels is followed by consonants."""
    return shape.count(b"vc")


def _short_end(word: str, shape: bytes) -> bool:
    return shape.endswith(b"cvc") and word[-1] not in "wxy"


def _by_end(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str]]]:
    """The rules by the last two letters of their suffixes, long ones first."""
    out: dict[str, list[tuple[str, str]]] = {}
    for rule in sorted(rules, key=lambda r: -len(r[0])):
        out.setdefault(rule[0][-2:], []).append(rule)
    return out


_ENDS_2, _ENDS_3, _ENDS_4 = _by_end(STEP_2), _by_end(STEP_3), _by_end(tuple((x, "") for x in STEP_4))


def _longest(word: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    for rule in rules.get(word[-2:], ()):
        if word.endswith(rule[0]):
            return rule
    return None


@lru_cache(maxsize=1 << 17)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with others than a-z, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word[-1] == "s":
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    shape = _shape(word)
    if word.endswith("eed"):
        word = word[:-1] if _measure(shape[:-3]) > 0 else word
    elif word.endswith(("ed", "ing")):
        body = word[: -2 if word[-1] == "d" else -3]
        own = shape[: len(body)]
        if b"v" in own:
            if body.endswith(("at", "bl", "iz")):
                word = body + "e"
            elif len(body) > 1 and body[-1] == body[-2] and own.endswith(b"c") and body[-1] not in "lsz":
                word = body[:-1]
            else:
                word = body + "e" if _measure(own) == 1 and _short_end(body, own) else body
            shape = _shape(word)
    if word.endswith("y") and b"v" in shape[: len(word) - 1]:
        word = word[:-1] + "i"
    for rules in (_ENDS_2, _ENDS_3):
        rule = _longest(word, rules)
        if rule and _measure(shape[: len(word) - len(rule[0])]) > 0:
            word = word[: -len(rule[0])] + rule[1]
            shape = _shape(word)
    rule = _longest(word, _ENDS_4)
    if rule:
        body = word[: -len(rule[0])]
        if _measure(shape[: len(body)]) > 1 and (rule[0] != "ion" or body.endswith(("s", "t"))):
            word = body
    shape = _shape(word)
    if word.endswith("e"):
        own = shape[:-1]
        if _measure(own) > 1 or _measure(own) == 1 and not _short_end(word[:-1], own):
            word, shape = word[:-1], own
    return word[:-1] if word.endswith("ll") and _measure(shape) > 1 else word


@lru_cache(maxsize=1)
def _accents() -> np.ndarray:
    """For each character whether it is an accent that stands for itself."""
    return np.array([unicodedata.combining(chr(c)) > 0 for c in range(sys.maxunicode + 1)])


def folded(text: str) -> str:
    """Lower case, without accents."""
    if text.isascii():
        return text.lower()
    chars = np.frombuffer(unicodedata.normalize("NFD", text.lower()).encode("utf-32-le", "surrogatepass"), "<u4")
    return chars[~_accents()[chars]].tobytes().decode("utf-32-le", "surrogatepass")


def analysed(text: str, analyser: str) -> list[str]:
    """The tokens of a text: `plain` runs of a-z and 0-9, `folded` runs of letters and digits, `porter` their stems."""
    if analyser == "plain":
        return _PLAIN.findall(text.lower())
    words = _TOKEN.findall(folded(text))
    return [porter(w) for w in words] if analyser == "porter" else words


def phrases(text: str, analyser: str) -> list[str]:
    """The terms of a query that quotes each run without white space: one token, or several that must stand together."""
    return [" ".join(w) for chunk in text.split() if (w := analysed(chunk, analyser))]

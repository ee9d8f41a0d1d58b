"""Text analysis for search: words, accents, stop words and stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: English words that queries leave out. Fixed values.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
WORD = re.compile(r"[^\W]+", re.UNICODE)


def _marks() -> re.Pattern:
    """All combining marks (category Mn), as ranges."""
    found, ranges = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Mn"], []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]+")


MARKS = _marks()
MARKED = frozenset(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Mn")
#: What isn't part of a word, in ASCII.
BLANKS = {c: " " for c in range(128) if not WORD.match(chr(c))}


def folded(text: str) -> str:
    """Lower case, without combining marks."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    some = MARKED & set(text)  # few, and far faster to replace than a class of all marks is to look for
    if len(some) > 40:
        return MARKS.sub("", text)
    for c in some:
        text = text.replace(c, "")
    return text


def split(text: str) -> list[str]:
    """The words of a folded text."""
    return text.translate(BLANKS).split() if text.isascii() else WORD.findall(text)


def words(text: str) -> list[str]:
    return split(folded(text))


VOWELS = set("aeiou")


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall(r"v+c+", kinds))


def _vowel(word: str, i: int) -> bool:
    return word[i] in VOWELS or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _short_end(word: str) -> bool:
    n = len(word)
    return n >= 3 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


#: Endings and what replaces them where the stem's measure exceeds the bound. Fixed values of Porter's algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter's stem of an ASCII word of three letters or more; others stay as they are."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in [*STEP4, "ion"] if w.endswith(e)), key=len, default=None)
    if end:
        base = w[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short_end(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def tokenize(text: str) -> list[str]:
    """What a search for this text looks up: stems, stop words left out."""
    return [stem(w) for w in words(text) if w not in STOP_WORDS]

"""An English suffix stemmer (Porter 1980): rules in five steps, each guarded by the measure of what remains.

The measure of a stem is the number of its vowel-consonant turns: 0 for ``tr``, 1 for ``trouble``
without its ``e``, 2 for ``troubles`` without ``es``. Words of up to two letters, and words with other
letters than a-z, stay as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes and what replaces them, by step (Porter 1980).
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
          ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """``v`` and ``c`` for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """Replace the longest suffix that fits if what is before it measures at least ``least``."""
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(old):
            stem = word[:-len(old)]
            return stem + new if measure(stem) >= least else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):  # plurals
        if word.endswith(old):
            word = word[:-len(old)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for old in ("ed", "ing"):
            if word.endswith(old) and "v" in _shape(word[:-len(old)]):
                word = word[:-len(old)]
                if word.endswith(("at", "bl", "iz")) or measure(word) == 1 and _short_end(word):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, STEP_2, 1)
    word = _longest(word, STEP_3, 1)
    for old in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(old):
            rest = word[:-len(old)]
            if measure(rest) > 1 and (old != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not _short_end(rest):
            word = rest
    if measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word

"""English stems by Porter's algorithm (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

#: The suffix rules of steps 2 to 4 of the paper.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _shape(stem: str) -> str:
    """Consonants and vowels as c and v."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    fits = [r for r in rules if word.endswith(r[0])]
    return max(fits, key=lambda r: len(r[0])) if fits else None


def _rules(text: str) -> list[tuple[str, str]]:
    return [tuple(r.split(":")) if ":" in r else (r, "") for r in text.split()]


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif _double(base) and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _cvc(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        if (r := _longest(word, _rules(rules))) and _measure(word[: -len(r[0])]):
            word = word[: -len(r[0])] + r[1]
    if r := _longest(word, _rules(STEP4)):
        base = word[: -len(r[0])]
        if _measure(base) > 1 and (r[0] != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word

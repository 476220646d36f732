"""The English (Porter2) stemmer, after its published description."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ty

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {"skis": "ski", "dying": "die", "lying": "lie", "tying": "tie", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = sorted({"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}.items(), key=lambda x: -len(x[0]))
_STEP3 = sorted({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}.items(), key=lambda x: -len(x[0]))
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=lambda x: -len(x))
_STEP2 += [("ogi", "og"), ("li", "")]
_STEP3 = sorted([*_STEP3, ("ative", "")], key=lambda x: -len(x[0]))
_STEP4 = sorted([*_STEP4, "ion"], key=lambda x: -len(x))
_FIRST, _PAIR, _VOWEL, _Y_AFTER = re.compile("(gener|commun|arsen)"), re.compile(f"[{_V}][^{_V}]"), re.compile(f"[{_V}]"), re.compile(f"([{_V}])y")
_SHORT, _TWO, _PLURAL = re.compile(f"[^{_V}][{_V}][^{_V}wxY]$"), re.compile(f"[{_V}][^{_V}]"), re.compile(f"[{_V}].+s$")


def _regions(w: str) -> tuple[int, int]:
    m = _FIRST.match(w)
    r1 = m.end() if m else ((m := _PAIR.search(w)) and m.end()) or len(w)
    m = _PAIR.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(_SHORT.search(w) or _TWO.fullmatch(w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    w = word
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _KEPT:
        return w
    w = w.removeprefix("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = _Y_AFTER.sub(r"\1Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and _PLURAL.search(w):
        w = w[:-1]
    if w in _KEPT_1A:
        return w.replace("Y", "y")
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif _VOWEL.search(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in "cdeghkmnrt"):
                w = w[: -len(s)] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(ty.StringType())
def stem_udf(s: pd.Series) -> pd.Series:
    return s.map(stem, na_action="ignore")

"""English stems by Porter's algorithm of 1980, with the usual later exceptions, for overlap scores."""

from __future__ import annotations

# Words with a stem of their own.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing", "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
# Endings and what replaces them, step by step; the first that fits is tried.
SECOND = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _kinds(word).count("vc")


def _closed(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; of two letters, in vowel and consonant."""
    kinds = _kinds(word)
    return (kinds.endswith("cvc") and word[-1] not in "wxy") or kinds == "vc"


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        stem = w[: -len(end)]
        if w.endswith(end) and "v" in _kinds(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-2])
    for end, new in SECOND:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w[:-1] if w.endswith("logi") and _measure(w[:-3]) > 0 else w


def _third(w: str) -> str:
    for end, new in THIRD:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w


def _fourth(w: str) -> str:
    for end in FOURTH:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else w
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _kinds(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _fourth(_third(_second(w)))
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _closed(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w

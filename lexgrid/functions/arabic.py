"""The Snowball stemmer for Arabic, written from the published description of the algorithm.

A word is freed of vowel signs, then loses at most one ending of each kind as a verb or else as a noun, then prefixes; forms of hamza
and alef become one at last. Lengths are in letters, and each affix asks for a least length of the word.
"""

from __future__ import annotations

import re

#: Vowel signs and the stretching letter are left out; digits and ligatures become plain. Fixed values.
MARKS = re.compile("[ً-ْـ]")
PLAIN = str.maketrans({**{chr(0x660 + i): str(i) for i in range(10)}, "ﻻ": "لا", "ﻼ": "لا", "ﻷ": "لأ", "ﻸ": "لأ", "ﻹ": "لإ", "ﻺ": "لإ", "ﻵ": "لآ", "ﻶ": "لآ"})
#: A last letter that carries hamza becomes hamza; elsewhere its carrier stays. Fixed values.
HAMZA_LAST = dict.fromkeys("أإآؤئ", "ء")
CARRIER = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ؤ": "و", "ئ": "ي"})

#: (least length of the word, endings). Fixed values.
NOUN_1A = ((6, ("كما", "هما")), (5, ("نا", "كم", "ها", "هن", "هم")), (4, ("ي", "ك", "ه")))
NOUN_1B = ((6, ("ن",)),)
NOUN_2A = ((5, ("ا", "ي", "و")),)
NOUN_2B = ((5, ("ات",)),)
NOUN_2C1 = ((4, ("ت",)),)
NOUN_2C2 = ((4, ("ة",)),)
NOUN_3 = ((3, ("ي",)),)
VERB_1 = ((6, ("هما", "كما", "كمو")), (5, ("ني", "نا", "ها", "هم", "هن", "كم", "كن")), (4, ("ه", "ك")))
VERB_2A = ((6, ("تما", "ان", "ون", "ين")), (5, ("نا", "تا", "تن")), (4, ("ت", "ا", "ن", "ي")))
VERB_2B = ((5, ("وا", "تم")),)
VERB_2C = ((6, ("تمو",)), (4, ("و",)))
#: (beginning, what stands for it, least length). Fixed values.
FIRST_HAMZA = (("أأ", "أ", 4), ("أآ", "آ", 4), ("أؤ", "ؤ", 4), ("أا", "ا", 4), ("أإ", "إ", 4))
ARTICLES = (("بال", "", 6), ("كال", "", 6), ("ال", "", 5), ("لل", "", 5))
NOUN_BEGINNINGS = (("بب", "ب", 4), ("كك", "ك", 4), ("ب", "", 4))
FUTURE = (("سي", "ي", 5), ("ست", "ت", 5), ("سن", "ن", 5), ("سأ", "أ", 5))
TENTH_FORM = (("يست", "است", 5), ("نست", "است", 5), ("تست", "است", 5))


def without(w: str, endings: tuple[tuple[int, tuple[str, ...]], ...]) -> str | None:
    """w without the longest of the endings that it has; None if there is none, or the word is too short for it."""
    found = max(((e, least) for least, some in endings for e in some if w.endswith(e)), key=lambda x: len(x[0]), default=None)
    return w[: -len(found[0])] if found and len(w) >= found[1] else None


def replaced(w: str, beginnings: tuple[tuple[str, str, int], ...]) -> str | None:
    found = max((b for b in beginnings if w.startswith(b[0])), key=lambda b: len(b[0]), default=None)
    return found[1] + w[len(found[0]) :] if found and len(w) >= found[2] else None


def verb_endings(w: str) -> str | None:
    cut = without(w, VERB_1)
    if cut is not None:
        while (more := without(cut, VERB_1)) is not None:
            cut = more
        for step in (VERB_2A, VERB_2C):
            if (more := without(cut, step)) is not None:
                return more
            return cut
    for step in (VERB_2B, VERB_2A):
        if (cut := without(w, step)) is not None:
            return cut
    return None


def first_of(w: str, *steps: tuple) -> str | None:
    return next((cut for step in steps if (cut := without(w, step)) is not None), None)


def noun_endings(w: str, defined: bool) -> tuple[str, bool]:
    """The word without its endings, and whether the last step was taken; what earlier steps took stays away."""

    def ending(w: str) -> str:
        if (cut := without(w, NOUN_2C2)) is not None:
            return cut
        if not defined and (cut := without(w, NOUN_1A)) is not None:
            return first_of(cut, NOUN_2A, NOUN_2B, NOUN_2C1) or cut
        if (cut := without(w, NOUN_1B)) is not None:
            w = cut
            if (cut := first_of(w, NOUN_2A, NOUN_2B, NOUN_2C1)) is not None:
                return cut
        return first_of(w, *([] if defined else [NOUN_2A]), NOUN_2B) or w

    w = ending(w)
    cut = without(w, NOUN_3)
    return (w, False) if cut is None else (cut, True)


def arabic(word: str) -> str:
    """The stem of a word."""
    verb, defined = True, False
    if word.startswith(("بال", "كال")) and len(word) > 4 or not word.startswith(("بال", "كال")) and word.startswith(("لل", "ال")) and len(word) > 3:
        verb, defined = False, True
    w = MARKS.sub("", word).translate(PLAIN)
    cut = verb_endings(w) if verb else None
    if cut is not None:
        w = cut
    else:
        w, taken = noun_endings(w, defined)
        if not taken and w.endswith("ى"):
            w = w[:-1] + "ي"
    w = replaced(w, FIRST_HAMZA) or w
    if w[:1] in ("ف", "و") and w[1:2] != "ا" and len(w) > 3:
        w = w[1:]
    if (cut := replaced(w, ARTICLES)) is not None:
        w = cut
    elif not w.startswith("با") and (cut := replaced(w, NOUN_BEGINNINGS)) is not None:
        w = cut
    elif verb:
        w = replaced(w, FUTURE) or w
        w = replaced(w, TENTH_FORM) or w
    if w[-1:] in HAMZA_LAST:
        w = w[:-1] + HAMZA_LAST[w[-1]]
    return w.translate(CARRIER)

"""Snowball stemmers for English, German, Spanish, French, Italian and Arabic, written from the published descriptions of the algorithms.

Languages without one keep their words. The stemmers run in an Arrow batch function over the distinct words of a corpus, each of
which is stemmed once; the dictionary of those that change is written, and tokens or counts meet it by word (V2).
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.functions.arabic import arabic
from lexgrid.operators.workspace import materialise

MEMO = 200_000


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant that follows a vowel, and the same again within R1."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in vowels and w[i - 1] in vowels:
                return i + 1
        return len(w)

    r1 = after(0)
    return r1, after(r1)


ENGLISH_VOWELS = "aeiouy"
#: Fixed values of the English algorithm.
ENGLISH_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ENGLISH_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
ENGLISH_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _short_end(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    v = ENGLISH_VOWELS
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) > 2 and w[-1] not in v + "wxY" and w[-2] in v and w[-3] not in v


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in ENGLISH_SPECIAL:
        return ENGLISH_SPECIAL[word]
    if word in ENGLISH_SAME:
        return word
    v = ENGLISH_VOWELS
    w = word.lstrip("'") if word.startswith("'") else word
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in v) else c for i, c in enumerate(w))
    r1, r2 = _regions(w, v)
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            r1 = len(start)
            r2 = _regions(w[r1:], v)[0] + r1
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in v for c in w[:-2]):
        w = w[:-1]
    if w in ENGLISH_AFTER_1A:
        return w
    # 1b
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end in ("eed", "eedly"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif any(c in v for c in w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    for end, new in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[:at].endswith("l")) and (end != "li" or w[:at].endswith(tuple("cdeghkmnrt"))):
                w = w[:at] + new
            break
    for end, new in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + new
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[:at].endswith(("s", "t"))):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:at]):
            w = w[:at]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v else c for i, c in enumerate(w))
    r1, r2 = _regions(w, v)
    r1 = max(r1, 3)
    for end in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "s" or at > 0 and w[at - 1] in "bdfghklmnrt"):
                w = w[:at]
                if end in ("e", "en", "es") and w.endswith("niss"):
                    w = w[:-1]
            break
    for end in ("est", "en", "er", "st"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "st" or at > 3 and w[at - 1] in "bdfghklmnt"):
                w = w[:at]
            break
    for end in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2:
                if end in ("end", "ung"):
                    w = w[:at]
                    if w.endswith("ig") and at - 2 >= r2 and not w.endswith("eig"):
                        w = w[:-2]
                elif end in ("ig", "ik", "isch"):
                    if not w[:at].endswith("e"):
                        w = w[:at]
                elif end in ("lich", "heit"):
                    w = w[:at]
                    if w.endswith(("er", "en")) and at - 2 >= r1:
                        w = w[:-2]
                else:
                    w = w[:at]
                    if w.endswith("lich") and at - 4 >= r2:
                        w = w[:-4]
                    elif w.endswith("ig") and at - 2 >= r2:
                        w = w[:-2]
            break
    return w.translate(str.maketrans("UYäöü", "uyaou"))


SPANISH_VOWELS = "aeiouáéíóúü"
PLAIN = str.maketrans("áéíóú", "aeiou")
#: Fixed values of the Spanish algorithm.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
SPANISH_R2 = "amientos imientos amiento imiento anzas ismos ables ibles istas anza icos icas ismo able ible ista osos osas ico ica oso osa".split()
SPANISH_IC = "aciones adoras adores ancias adora ación antes ancia ador ante".split()
SPANISH_Y = "yamos yeron yendo yais yan yen yas yes ya ye yo yó".split()
SPANISH_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _longest(w: str, ends: list[str], start: int = 0) -> str | None:
    """The longest of the endings that w has, from place start on."""
    return max((e for e in ends if w.endswith(e) and len(w) - len(e) >= start), key=len, default=None)


def _romance_rv(w: str, vowels: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def spanish(word: str) -> str:
    v, w = SPANISH_VOWELS, word
    rv = _romance_rv(w, v)
    r1, r2 = _regions(w, v)
    # attached pronouns
    end = _longest(w, PRONOUNS, rv)
    if end:
        rest = w[: -len(end)]
        verb = _longest(rest, ["iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"], rv)
        if verb and (verb != "yendo" or rest.endswith("uyendo")):
            w = rest[: -len(verb)] + verb.translate(PLAIN)
    # standard endings
    before = w
    found = _longest(w, [*SPANISH_R2, *SPANISH_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    if found:
        at = len(w) - len(found)

        def drop(*ends: str) -> bool:
            nonlocal w
            e = _longest(w, list(ends))
            if e and len(w) - len(e) >= r2:
                w = w[: -len(e)]
                return True
            return False

        if found == "amente":
            if at >= r1:
                w = w[:at]
                if w.endswith("iv"):
                    if drop("iv"):
                        drop("at")
                else:
                    drop("os", "ic", "ad")
        elif at >= r2:
            w = w[:at]
            if found in SPANISH_IC:
                drop("ic")
            elif found in ("logía", "logías"):
                w += "log"
            elif found in ("ución", "uciones"):
                w += "u"
            elif found in ("encia", "encias"):
                w += "ente"
            elif found == "mente":
                drop("ante", "able", "ible")
            elif found in ("idad", "idades"):
                drop("abil", "ic", "iv")
            elif found in ("iva", "ivo", "ivas", "ivos"):
                drop("at")
    # verb endings
    if w == before:
        end = _longest(w, SPANISH_Y, rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _longest(w, [*SPANISH_VERBS, "en", "es", "éis", "emos"], rv)
            if end:
                w = w[: -len(end)]
                if end in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    # residual endings
    end = _longest(w, ["os", "a", "o", "á", "í", "ó", "e", "é"], rv)
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(PLAIN)


FRENCH_VOWELS = "aeiouyâàëéêèïîôûù"
#: Fixed values of the French algorithm.
FRENCH_R2 = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FRENCH_I = "îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
FRENCH_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FRENCH_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
FRENCH_1 = [*FRENCH_R2, *"atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()]


def french(word: str) -> str:
    v = FRENCH_VOWELS
    marked = []
    for i, c in enumerate(word):
        left, right = i > 0 and marked[-1] in v, i + 1 < len(word) and word[i + 1] in v
        if c in "ui" and left and right or c == "y" and (left or right) or c == "u" and i > 0 and word[i - 1] == "q":
            c = c.upper()
        marked.append(c)
    w = "".join(marked)
    if w.startswith(("par", "col", "tap")) or len(w) > 1 and w[0] in v and w[1] in v:
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    r1, r2 = _regions(w, v)
    start = w
    verbs = False  # whether step 1 leaves the word to the verb endings

    def cut(end: str, start: int, new: str = "") -> bool:
        nonlocal w
        if w.endswith(end) and len(w) - len(end) >= start:
            w = w[: len(w) - len(end)] + new
            return True
        return False

    found = _longest(w, FRENCH_1)
    if found is None:
        verbs = True
    elif found in FRENCH_R2:
        cut(found, r2)
    elif found in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if cut(found, r2) and not cut("ic", r2):
            cut("ic", 0, "iqU")
    elif found in ("logie", "logies"):
        cut(found, r2, "log")
    elif found in ("usion", "ution", "usions", "utions"):
        cut(found, r2, "u")
    elif found in ("ence", "ences"):
        cut(found, r2, "ent")
    elif found in ("ement", "ements"):
        if cut(found, rv):
            if w.endswith("iv"):
                if cut("iv", r2):
                    cut("at", r2)
            elif w.endswith("eus"):
                if not cut("eus", r2):
                    cut("eus", r1, "eux")
            elif w.endswith(("abl", "iqU")):
                cut(w[-3:], r2)
            else:
                cut("ièr", rv, "i") or cut("Ièr", rv, "i")
    elif found in ("ité", "ités"):
        if cut(found, r2):
            if w.endswith("abil"):
                cut("abil", r2) or cut("abil", 0, "abl")
            elif w.endswith("ic"):
                cut("ic", r2) or cut("ic", 0, "iqU")
            else:
                cut("iv", r2)
    elif found in ("if", "ive", "ifs", "ives"):
        if cut(found, r2) and cut("at", r2) and w.endswith("ic"):
            cut("ic", r2) or cut("ic", 0, "iqU")
    elif found == "eaux":
        cut(found, 0, "eau")
    elif found == "aux":
        cut(found, r1, "al")
    elif found in ("euse", "euses"):
        cut(found, r2) or cut(found, r1, "eux")
    elif found in ("issement", "issements"):
        at = len(w) - len(found)
        if at and w[at - 1] not in v:
            cut(found, r1)
    elif found == "amment":
        cut(found, rv, "ant")
        verbs = True
    elif found == "emment":
        cut(found, rv, "ent")
        verbs = True
    else:
        at = len(w) - len(found)
        if at > rv and w[at - 1] in v:
            cut(found, rv)
        verbs = True
    if w == start:
        verbs = True
    altered = w != start
    if verbs:
        now = w
        end = _longest(w, FRENCH_I, rv)
        at = len(w) - len(end or "")
        if end and at > rv and w[at - 1] not in v:
            w = w[:at]
        if w == now:
            end = _longest(w, ["ions", *FRENCH_E, *FRENCH_A], rv)
            if end == "ions":
                cut(end, r2)
            elif end:
                w = w[: len(w) - len(end)]
                if end in FRENCH_A:
                    cut("e", rv)
        altered = altered or w != now
    if altered:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        end = _longest(w, ["ion", "ier", "ière", "Ier", "Ière", "e", "ë"], rv)
        if end == "ion":
            at = len(w) - 3
            if at > rv and w[at - 1] in "st":
                cut(end, r2)
        elif end in ("ier", "ière", "Ier", "Ière"):
            cut(end, rv, "i")
        elif end == "e" or end == "ë" and w.endswith("guë"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    tail = len(w)
    while tail and w[tail - 1] not in v:
        tail -= 1
    if 0 < tail < len(w) and w[tail - 1] in "éè":
        w = w[: tail - 1] + "e" + w[tail:]
    return w.replace("U", "u").replace("I", "i").replace("Y", "y")


ITALIAN_VOWELS = "aeiouàèìòù"
GRAVE = str.maketrans("áéíóú", "àèìòù")
#: Fixed values of the Italian algorithm.
ITALIAN_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
ITALIAN_R2 = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
ITALIAN_1 = [*ITALIAN_R2, *"azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive".split()]
ITALIAN_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete "
    "erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita "
    "ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(word: str) -> str:
    v = ITALIAN_VOWELS
    w = word.translate(GRAVE).replace("qu", "qU")
    w = "".join(c.upper() if c in "ui" and 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v else c for i, c in enumerate(w))
    rv = _romance_rv(w, v)
    r1, r2 = _regions(w, v)

    def cut(end: str, start: int, new: str = "") -> bool:
        nonlocal w
        if w.endswith(end) and len(w) - len(end) >= start:
            w = w[: len(w) - len(end)] + new
            return True
        return False

    end = _longest(w, ITALIAN_PRONOUNS)
    if end:
        rest = w[: -len(end)]
        if len(rest) - 4 >= rv and rest.endswith(("ando", "endo")):
            w = rest
        elif len(rest) - 2 >= rv and rest.endswith(("ar", "er", "ir")):
            w = rest + "e"
    before = w
    found = _longest(w, ITALIAN_1)
    if found in ITALIAN_R2:
        cut(found, r2)
    elif found in ("azione", "azioni", "atore", "atori"):
        cut(found, r2) and cut("ic", r2)
    elif found in ("logia", "logie"):
        cut(found, r2, "log")
    elif found in ("uzione", "uzioni", "usione", "usioni"):
        cut(found, r2, "u")
    elif found in ("enza", "enze"):
        cut(found, r2, "ente")
    elif found in ("amento", "amenti", "imento", "imenti"):
        cut(found, rv)
    elif found == "amente":
        if cut(found, r1):
            if w.endswith("iv"):
                cut("iv", r2) and cut("at", r2)
            else:
                cut("os", r2) or cut("ic", r2) or cut("abil", r2)
    elif found == "ità":
        cut(found, r2) and (cut("abil", r2) or cut("ic", r2) or cut("iv", r2))
    elif found:
        cut(found, r2) and cut("at", r2) and cut("ic", r2)
    if w == before:
        end = _longest(w, ITALIAN_VERBS, rv)
        if end:
            w = w[: -len(end)]
    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.replace("U", "u").replace("I", "i")


STEMMERS = {"ar": arabic, "en": english, "de": german, "es": spanish, "fr": french, "it": italian}


@functools.lru_cache(MEMO)
def stem(language: str | None, word: str) -> str:
    f = STEMMERS.get(language or "")
    return f(word) if f else word


def stem_words(df: DataFrame, word: str = "word", into: str = "base") -> DataFrame:
    """df with the stem of a word column, by the row's lang. Give it distinct words to stem each once."""

    @F.pandas_udf("string")
    def of(lang: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else stem(g, x) for g, x in zip(lang, w)])

    return df.withColumn(into, of("lang", word))


def dictionary(words: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """(lang, word, base) of the words (lang, word) whose base differs, each stemmed once.

    stems: a user's table (lang, word, base), which goes before the stemmers.
    """
    words = words.where("lang IS NOT NULL AND word IS NOT NULL").distinct()
    if stems is None:
        return materialise(stem_words(words).where("base <> word"))
    own = stems.where("base IS NOT NULL").groupBy("lang", "word").agg(F.min("base").alias("own"))
    based = stem_words(words).join(own, ["lang", "word"], "left").select("lang", "word", F.coalesce("own", "base").alias("base"))
    return materialise(based.where("base <> word"))


#: A table of so many bases goes along with the plan; a larger one meets the words by joins.
FEW = 5_000


def lookup(bases: DataFrame) -> dict[str, list[dict[str, str]]] | None:
    """By language the bases of words, dealt to lists of a few by the words' hashes; None if there are too many, or a word has several."""
    rows = bases.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word", "base", F.xxhash64("word").alias("h")).limit(FEW + 1).collect()
    if len(rows) > FEW or len({(r["lang"], r["word"]) for r in rows}) < len(rows):
        return None
    found: dict[str, list[dict[str, str]]] = {}
    n = max(1, len(rows) // 2)
    for r in rows:
        found.setdefault(r["lang"], [{} for _ in range(n)])[r["h"] % n][r["word"]] = r["word"] if r["base"] is None else r["base"]
    return found


def looked_up(found: dict[str, list[dict[str, str]]]) -> Column:
    """The column `tokens`, with each replaced where it lies; the table is a constant, and a token is compared with a few words of it."""
    table = F.from_json(F.lit(json.dumps(found)), "map<string, array<map<string, string>>>")
    n = F.lit(max((len(x) for x in found.values()), default=1))

    def replaced(own: Column) -> Column:
        return F.transform("tokens", lambda t: F.coalesce(F.get(own, F.pmod(F.xxhash64(t), n).cast("int"))[t], t))

    return F.get(F.transform(F.array(F.element_at(table, F.col("lang"))), replaced), F.lit(0))  # a look for the language once a row


def based_tokens(df: DataFrame, bases: DataFrame) -> DataFrame:
    """df with each of its tokens replaced by its base in the table (lang, word, base), where it has one; the order stays.

    With few bases nothing is shuffled or written. With more, a text's tokens are dealt out by word; of one text a word is sent
    once, so even the most frequent word has a row a text at most.
    """
    none = F.array().cast("array<string>")
    found = lookup(bases)
    if found is not None:
        return df.withColumn("tokens", F.coalesce(looked_up(found), none))
    rows = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
    words = rows.select("__row", "lang", F.explode(F.array_distinct("tokens")).alias("word"))
    changed = words.join(bases, ["lang", "word"]).select("__row", "word", "base")
    each = rows.select("__row", F.posexplode("tokens").alias("at", "word")).join(changed, ["__row", "word"], "left")
    back = each.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("base", "word").alias("base")))).alias("__x"))
    tokens = F.coalesce(F.transform("__x", lambda x: x["base"]), none)
    return rows.join(back, "__row", "left").select(*[tokens.alias(c) if c == "tokens" else F.col(f"`{c}`") for c in df.columns])


def stem_tokens(df: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """df with every word of its tokens stemmed, by the row's lang; no token array leaves the JVM.

    stems: a user's table (lang, word, base), for languages without a stemmer here or in place of its stems.
    """
    return based_tokens(df, dictionary(df.select("lang", F.explode(F.array_distinct("tokens")).alias("word")), stems))


def based_frequencies(tf: DataFrame, bases: DataFrame) -> DataFrame:
    """(lang, doc_id, term, c, dl) of bases, from that of words: words are looked up once a document, whatever their places."""
    met = tf.join(bases.withColumnRenamed("word", "term"), ["lang", "term"], "left")
    return met.groupBy("lang", "doc_id", F.coalesce("base", "term").alias("term"), "dl").agg(F.sum("c").alias("c"))

"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much text is rejected.

A line fails by its punctuation (symbols, shouting, exclamations, a fragment that ends in none), as navigation (a row of
capitalised words, or of items between bars, that ends no sentence) or as boilerplate (furniture of a site, in the languages of
BOILERPLATE). DataFrame functions only; one pass over the texts, no shuffle.

Defined cases: a null or blank text has no words, so base_failed is true and kept false. Blank lines carry no text
and are neither failed nor counted. Long texts are judged whole. Repeated rows are judged one by one, an empty table gives no
rows. Extra columns pass through; in `judge` one named as the result is replaced by it, `clean` leaves all but the text as they
are.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import BLANKS, count_of, let, words

SYMBOLS = "#*$%&|<>"
#: Phrases of lines that are furniture of a site, not text (lower case). Fixed values.
BOILERPLATE = (
    "enable javascript", "use cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "subscribe to our", "sign up for", "click here", "log in to", "share this", "skip to content", "back to top", "read more about", "follow us on",
    "javascript aktivieren", "verwenden cookies", "verwendet cookies", "datenschutzerkl\u00e4rung", "nutzungsbedingungen", "alle rechte vorbehalten",
    "newsletter abonnieren", "hier klicken", "jetzt anmelden", "zum inhalt springen", "nach oben", "impressum",
    "activer javascript", "utilise des cookies", "utilisons des cookies", "politique de confidentialit\u00e9", "conditions d'utilisation", "tous droits r\u00e9serv\u00e9s",
    "abonnez-vous", "cliquez ici", "se connecter", "aller au contenu", "haut de page", "mentions l\u00e9gales",
    "activar javascript", "utiliza cookies", "utilizamos cookies", "pol\u00edtica de privacidad", "condiciones de uso", "todos los derechos reservados",
    "suscr\u00edbete", "haga clic aqu\u00ed", "haz clic aqu\u00ed", "iniciar sesi\u00f3n", "ir al contenido", "volver arriba", "aviso legal",
)
TERMINAL = "[.!?:;)\\]\"'\\u2026\\u201d\\u00bb]$"
#: What stands between the items of a menu, and a word that starts with a capital letter.
BARS, CAPITAL = " [|/>\\u00b7\\u2022\\u203a] ", "(^|[ \\x09-\\x0D])\\p{Lu}"


def line_fails(line: Column) -> Column:
    """True for a line that breaks a rule on punctuation, navigation, shouting or boilerplate. `line` has no blanks at its ends."""
    size = F.length(line)
    symbols = count_of(line, SYMBOLS) * 20 > size
    shouting = (size >= 12) & (count_of(line, "A-Z") * 2 > size)
    exclaiming = count_of(line, "!") * 10 > size
    unended = ~line.rlike(TERMINAL)
    n = F.regexp_count(line, F.lit("[^ \\x09-\\x0D]+"))
    menu = (n >= 3) & ((F.regexp_count(line, F.lit(CAPITAL)) * 10 >= n * 7) | (F.regexp_count(line, F.lit(BARS)) >= 2))
    furniture = let(F.lower(line), lambda x: reduce(or_, [x.contains(p) for p in BOILERPLATE]))
    return symbols | shouting | exclaiming | (unended & ((size < 30) | menu)) | furniture


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array, the first place included.

    A long holds a window's hash above the window's place, which takes as many bits as the array needs. Sorted, equal windows are
    neighbours; the places of equal neighbours, sorted, then cover up to three words each, an overlap once. Neighbours of one
    hash are compared word by word; should two differ, the windows themselves are sorted instead.
    """
    n = F.size(w)
    places = F.sequence(F.lit(0), n - 3)
    bits = F.length(F.bin(n))
    window = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
    shift = lambda x, k: F.call_function("shiftleft", x, k)

    def count(hit: Column) -> Column:
        return F.aggregate(
            F.sort_array(hit),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
            lambda a: a["n"],
        )

    def by_hash(bits: Column) -> Column:
        low = shift(F.lit(1).cast("long"), bits) - 1
        codes = F.sort_array(F.transform(places, lambda i: shift(F.xxhash64(*window(i)), bits).bitwiseOR(i.cast("long"))))

        def found(s: Column) -> Column:
            of = lambda x: F.call_function("shiftright", x, bits)
            place = lambda x: x.bitwiseAND(low).cast("int")
            # The places of neighbours of one hash; the second of two that are not equal is marked by -1.
            before = F.filter(F.transform(s, lambda x, k: F.when((k > 0) & (of(F.get(s, k - 1)) == of(x)), k)), lambda k: k.isNotNull())

            def judged(ks: Column) -> Column:
                same = F.forall(ks, lambda k: F.struct(*window(place(F.get(s, k - 1)))) == F.struct(*window(place(F.get(s, k)))))
                hit = F.flatten(F.transform(ks, lambda k: F.array(place(F.get(s, k - 1)), place(F.get(s, k)))))
                return F.when(F.size(ks) == 0, F.lit(0)).when(same, count(hit)).otherwise(by_words())

            return let(before, judged)

        return let(codes, found)

    def by_words() -> Column:
        rows = F.sort_array(F.transform(places, lambda i: F.struct(F.struct(*[x.alias(f"w{k}") for k, x in enumerate(window(i))]).alias("w"), i.alias("i"))))
        hit = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | (F.get(s, k + 1)["w"] == x["w"]))
        return let(rows, lambda s: count(F.transform(hit(s), lambda x: x["i"])))

    return F.when(n < 4, F.lit(0)).otherwise(let(bits, by_hash)).cast("long")


def rules(text: str = "text", most_lost: float = 0.5) -> Column:
    """A struct with the counts, the lines lost, the text left and the verdict.

    A document is kept if the base rules hold (50 words, at most half of them in repeated windows) and the lines that
    pass, each equal line counted once, hold at least 1 - most_lost of the characters of its lines.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    raw = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"))

    def size_of(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)).cast("long")

    def of_lines(lines: Column, bare: Column) -> Column:
        return let(F.filter(F.array_distinct(bare), lambda x: ~line_fails(x)), lambda ok: F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            (F.size(lines) - F.size(ok)).cast("long").alias("n_lost_lines"),
            size_of(bare).alias("total"),
            size_of(ok).alias("left"),
            F.array_join(ok, "\n").alias("cleaned"),
        ))

    def verdict(w: Column, lines: Column) -> Column:
        base_failed = (w["n_words"] < 50) | (w["n_repeat_words"] * 100 > w["n_words"] * 50)
        return F.struct(
            w["n_words"].alias("n_words"),
            w["word_chars"].alias("word_chars"),
            count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            base_failed.alias("base_failed"),
            (~base_failed & (lines["left"] >= lines["total"] * (1 - most_lost))).alias("kept"),
            lines["n_lost_lines"].alias("n_lost_lines"),
            (lines["total"] - lines["left"]).alias("lost_chars"),
            lines["cleaned"].alias("cleaned"),
        )

    lines = let(raw, lambda x: let(F.transform(x, lambda y: F.btrim(y, F.lit(BLANKS))), lambda bare: of_lines(x, bare)))
    return let(let(words(t), of_words), lambda w: let(lines, lambda x: verdict(w, x)))


def judge(docs: DataFrame, text: str = "text", most_lost: float = 0.5, name: str = "rules") -> DataFrame:
    """All columns of docs, plus the struct of `rules`."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], rules(text, most_lost).alias(name))


def clean(docs: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """The documents that pass, with the columns they came with; the text is what is left of its lines."""
    # A filter would be moved below the projection and the rules evaluated twice; a generator is evaluated once.
    found = docs.select(F.struct("*").alias("row"), F.explode(F.filter(F.array(rules(text, most_lost)), lambda x: x["kept"])).alias("rules"))
    return found.select(*[(F.col("rules.cleaned") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

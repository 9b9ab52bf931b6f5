"""Line-first quality rules, in DataFrame functions only.

Each line that holds a word is judged by itself: it fails by punctuation (no sentence end in it, or
every third word or more carries symbols or doubled marks), by navigation (every fourth word or more
is a separator, or a short line of menu words in one of four languages without a sentence end) or by boilerplate (a fixed
phrase of notices and consent banners in a line of at most 200 characters). Failing lines go. A document goes if that
loses more than half of its word characters, or if a base rule fails: fewer than 10 words, or more
than 20 % of the words in five-word windows that the text repeats.

Defined cases: a null or empty text has no words and goes; lines without a word are neither judged
nor counted; ties and repeated rows are judged each on its own; texts of any length are judged whole, in the
memory of their words and lines; an empty table gives an empty result; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import col, fresh, whole_row

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MAX_LOST = 10, 20, 5, 0.5
#: Characters of a short line; hashes up to which repeated windows are looked up one by one.
SHORT, FEW = 200, 64

# The words and phrases of the navigation and boilerplate rules, in English, German, French and Spanish.
MENU = (
    "home menu login logout register search next previous prev back share print sitemap archive contact about faq help",
    "startseite anmelden abmelden registrieren suche suchen weiter zurück teilen drucken impressum archiv kontakt hilfe",
    "accueil connexion inscription recherche rechercher suivant précédent retour partager imprimer archives aide plan",
    "inicio entrar salir registro buscar siguiente anterior volver compartir imprimir mapa archivo contacto ayuda",
)
NOTICES = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|accept cookies|enable javascript|click here|sign up now|subscribe to our|skip to content|lorem ipsum",
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|javascript aktivieren|hier klicken|jetzt anmelden|zum inhalt springen",
    "tous droits réservés|politique de confidentialité|conditions d'utilisation|accepter les cookies|activer javascript|cliquez ici|abonnez-vous|aller au contenu",
    "todos los derechos reservados|política de privacidad|términos de uso|condiciones de uso|aceptar cookies|activar javascript|haga clic aquí|suscríbase|saltar al contenido",
)
MENU_WORDS = "|".join("|".join(words.split()) for words in MENU)
PHRASES = f"(?:^|[^a-zà-ÿ])(?:{'|'.join(NOTICES)})"

_SENTENCE_END = r"[.!?…。！？؟][\"'”’“‘»«)\]]*(\s|\z)"
_NOISY = r"[!?]{2,}|[#*$%&<>{}~^]{2,}|[#*$%&<>|{}~^]\z"
_SEPARATOR = r"^[|»›>·•/\\-]+\z"
_MARK = r"[|»›>·•/\\!?#*$%&<{}~^-]"
_MENU = rf"^(?:{MENU_WORDS})\z"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]++", ""))


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]++", ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five that occur twice or more.

    64-bit hashes of the windows tell most texts apart in linear time. In the others the hashes that
    occur twice select the windows to compare: sorted with their places, equal neighbours mark the
    repeated places, and each of them covers the words up to the next one, five at most.
    """
    n = F.size(words) - WINDOW + 1
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def judge(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == n, 0).otherwise(let(F.array_sort(h), lambda x: let(_twice(x), lambda twice: count(h, twice))))

    def count(h: Column, twice: Column) -> Column:
        some = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.size(twice) > FEW) | F.array_contains(twice, F.get(h, i)))
        windows = F.sort_array(F.transform(some, lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("i"))))
        return F.aggregate(
            let(windows, _same_neighbours),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    return F.when(n < 2, 0).otherwise(let(hashes, judge)).cast("bigint")


def _twice(ordered: Column) -> Column:
    """The values that a sorted array holds more than once."""
    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.array_distinct(F.array_compact(F.zip_with(ordered, rest, lambda a, b: F.when(a == b, a))))


def _same_neighbours(windows: Column) -> Column:
    """Places, in order, of the sorted (w, i) whose w equals that before or after."""
    n = F.size(windows)
    none = F.array(F.lit(None).cast("string"))
    names = F.transform(windows, lambda x: x["w"])
    before = F.concat(none, F.slice(names, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(names, 2, F.greatest(n - 1, F.lit(0))), none)
    same = F.filter(F.arrays_zip(windows.alias("x"), before.alias("b"), after.alias("a")), lambda z: (z["x"]["w"] == z["b"]) | (z["x"]["w"] == z["a"]))
    return F.sort_array(F.transform(same, lambda z: z["x"]["i"]))


def line_fails(line: Column) -> Column:
    """The first rule a line fails, or null: punctuation, navigation or boilerplate."""
    ends = line.rlike(_SENTENCE_END)

    def marked(words: Column) -> Column:
        n = F.size(words)
        separators = F.size(F.filter(words, lambda w: w.rlike(_SEPARATOR)))
        noisy = F.size(F.filter(words, lambda w: w.rlike(_NOISY)))
        return F.when(let(separators, lambda k: (k >= 2) & (4 * k >= n)), "navigation").when(3 * noisy >= n, "punctuation")

    def unended(words: Column) -> Column:
        menu = F.size(F.filter(F.split(F.lower(line), "[^a-zà-ÿ]+"), lambda w: w.rlike(_MENU)))
        return F.when((F.size(words) <= 12) & (2 * menu >= F.size(words)), "navigation").otherwise("punctuation")

    # Words are split only for lines with a mark, without a sentence end or with a phrase.
    return F.coalesce(
        F.when(line.rlike(_MARK), let(words_of(line), marked)),
        F.when(~ends, let(words_of(line), unended)),
        F.when((F.length(line) <= SHORT) & F.lower(line).rlike(PHRASES), "boilerplate"),
    )


def quality(docs: DataFrame, *, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with a struct column ``quality``: the base figures, base_failed, kept, clean_text.

    ``clean_text`` is the text without the failing lines.
    """
    out = fresh(docs, "quality")
    rows = docs.select(whole_row(docs).alias("d"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("d", "t", words_of(F.col("t")).alias("words"), F.split("t", "\n").alias("lines"))
    # One verdict a line: null without a word, empty for a pass, else the rule that it fails.
    rows = rows.withColumn("verdicts", F.transform("lines", lambda x: F.when(has_word(x), F.coalesce(line_fails(x), F.lit("")))))
    some = F.filter("lines", lambda x, i: F.get("verdicts", i).isNotNull())
    rows = rows.select(
        "d",
        "t",
        "lines",
        "verdicts",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        symbols(F.col("t")).cast("bigint").alias("n_symbols"),
        let(some, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.exists("verdicts", lambda v: v != "").alias("some_fail"),
    )
    rows = rows.select("*", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))
    fails = lambda i: F.coalesce(F.get("verdicts", i) != "", F.lit(False))
    lost = F.when(F.col("some_fail"), word_chars(F.array_join(F.filter("lines", lambda x, i: fails(i)), ""))).otherwise(0)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("word_chars") - lost >= (1 - max_lost) * F.col("word_chars")))
    clean = F.when(F.col("some_fail"), F.array_join(F.filter("lines", lambda x, i: ~fails(i)), "\n")).otherwise(F.col("t"))
    figures = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", clean.alias("clean_text"))
    return rows.select("d.*", figures.alias(out))

"""Which language a text is in, by frequent words, telling letters and scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and letters that tell a language, and the scripts of others.
WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "on"],
    "fr": ["le", "la", "les", "des", "et", "un", "une", "est", "du", "dans", "pour"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "den", "auf"],
    "es": ["el", "los", "las", "y", "que", "por", "con", "para", "una", "del", "se"],
}
LETTERS = {"en": "", "fr": "çèêàùûœ", "de": "äöüß", "es": "ñóíúá¿¡"}
SCRIPTS = {"hi": ("\u0900", "\u097f"), "bn": ("\u0980", "\u09ff"), "ta": ("\u0b80", "\u0bff"), "te": ("\u0c00", "\u0c7f")}


def language_scores(text: Column) -> dict[str, Column]:
    """For each language: three for each of its words in the text, one for each of its letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda pattern: F.size(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)))
    scores = {lang: 3 * count(rf"(?<![\p{{L}}]){'(?:' + '|'.join(words) + ')'}(?![\p{{L}}])") + (count(f"[{LETTERS[lang]}]") if LETTERS[lang] else 0) for lang, words in WORDS.items()}
    return scores | {lang: count(f"[{a}-{z}]") for lang, (a, z) in SCRIPTS.items()}


def language(text: Column, supported: tuple[str, ...] = ("en", "fr", "de", "es", "hi", "bn", "ta", "te"), requested: Column | None = None) -> Column:
    """The best scored language that is supported, English on a tie or without any sign; a request other than auto is kept."""
    scores = {k: v for k, v in language_scores(text).items() if k in supported}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    ties = sum((F.when(v == best, 1).otherwise(0) for v in scores.values()), F.lit(0))
    found = F.when(ties > 1, "en")
    for lang, score in scores.items():
        found = found.when(score == best, lang)
    found = found.otherwise("en")
    return found if requested is None else F.when(requested != "auto", requested).otherwise(found)

"""Porter's stemmer: the rules as a table, applied as Column expressions and written as SQL.

A word's form says for each letter whether it is a vowel (v) or a consonant (c); y is a vowel after a
consonant. The measure of a stem is how often a consonant follows a vowel in its form. In each step
the longest suffix that fits counts; if its condition on the stem doesn't hold, nothing changes.
Words of ASCII letters of 3 to 64 characters are stemmed, others stay; null stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffix, what replaces it, and the condition on the stem, as published with the algorithm (and its two later rules bli, logi).
STEP_1A = [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]
STEP_2 = [(a, b, "m>0") for a, b in (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)]
STEP_3 = [(a, b, "m>0") for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))]
STEP_4 = [(a, "", "m>1 st" if a == "ion" else "m>1") for a in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")]


class _Spark:
    """Builds the rules' conditions from Columns; _Sql below builds them as text."""

    when = staticmethod(lambda pairs, other: _case(pairs, other))
    lit = staticmethod(F.lit)
    ends = staticmethod(lambda w, s: F.endswith(w, F.lit(s)))
    cut = staticmethod(lambda w, n: F.substring(w, F.lit(1), F.length(w) - n))
    join = staticmethod(lambda w, s: F.concat(w, F.lit(s)) if s else w)
    matches = staticmethod(lambda w, p: w.rlike(p))
    both = staticmethod(lambda a, b: a & b)
    no = staticmethod(lambda a: ~a)
    shorter = staticmethod(lambda w, n: F.length(w) < n)
    last = staticmethod(lambda w, n: F.substring(w, F.length(w) - n + 1, F.lit(n)))
    head = staticmethod(lambda w, n: F.substring(w, F.lit(1), F.length(n)))


def _case(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(other)


class _Sql:
    when = staticmethod(lambda pairs, other: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END")
    lit = staticmethod(lambda s: f"'{s}'")
    ends = staticmethod(lambda w, s: f"suffix({w}, '{s}')")
    cut = staticmethod(lambda w, n: f"substr({w}, 1, length({w}) - {n})")
    join = staticmethod(lambda w, s: f"({w} || '{s}')" if s else w)
    matches = staticmethod(lambda w, p: f"regexp_matches({w}, '{p}')")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    no = staticmethod(lambda a: f"(NOT {a})")
    shorter = staticmethod(lambda w, n: f"(length({w}) < {n})")
    last = staticmethod(lambda w, n: f"substr({w}, length({w}) - {n - 1}, {n})")
    head = staticmethod(lambda w, n: f"substr({w}, 1, length({n}))")


def _condition(e, name: str, stem, form):
    """A published condition over a stem and its form."""
    if name == "m>1 st":
        return e.both(e.matches(form, "vc+v+c"), e.matches(stem, "[st]$"))
    if name == "*o":  # ends consonant, vowel, consonant other than w, x and y
        return e.both(e.matches(form, "cvc$"), e.matches(stem, "[^wxy]$"))
    return e.matches(form, {"m>0": "vc", "m>1": "vc+v+c", "*v*": "v", "m=1": "^c*v+c+v*$"}[name])


def _step(e, rules, w, form):
    pairs = []
    for suffix, by, name in sorted(rules, key=lambda r: -len(r[0])):
        stem = e.cut(w, len(suffix))
        done = e.join(stem, by)
        pairs.append((e.ends(w, suffix), done if not name else e.when([(_condition(e, name, stem, e.head(form, stem)), done)], w)))
    return e.when(pairs, w)


def _step_1b(e, w, form):
    """eed, ed and ing; what is left of the latter two is marked by a dot, for the next step."""
    stem = e.cut(w, 3)
    eed = e.when([(_condition(e, "m>0", stem, e.head(form, stem)), e.cut(w, 1))], w)
    marked = lambda n: e.when([(e.matches(e.head(form, e.cut(w, n)), "v"), e.join(e.cut(w, n), "."))], w)
    return e.when([(e.ends(w, "eed"), eed), (e.ends(w, "ed"), marked(2)), (e.ends(w, "ing"), marked(3))], w)


def _mend_1b(e, w, form):
    stem = e.cut(w, 1)
    own = e.head(form, stem)
    double = e.both(e.matches(own, "cc$"), e.matches(stem, "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"))
    short = e.both(_condition(e, "m=1", stem, own), _condition(e, "*o", stem, own))
    left = e.when([(e.matches(stem, "(at|bl|iz)$"), e.join(stem, "e")), (double, e.cut(stem, 1)), (short, e.join(stem, "e"))], stem)
    return e.when([(e.ends(w, "."), left)], w)


def _step_1c(e, w, form):
    stem = e.cut(w, 1)
    return e.when([(e.both(e.ends(w, "y"), e.matches(e.head(form, stem), "v")), e.join(stem, "i"))], w)


def _step_5a(e, w, form):
    stem = e.cut(w, 1)
    own = e.head(form, stem)
    stays = e.no(_condition(e, "*o", stem, own))
    return e.when([(e.both(e.ends(w, "e"), _condition(e, "m>1", stem, own)), stem), (e.both(e.both(e.ends(w, "e"), _condition(e, "m=1", stem, own)), stays), stem)], w)


def _step_5b(e, w, form):
    return e.when([(e.both(e.ends(w, "ll"), _condition(e, "m>1", w, form)), e.cut(w, 1))], w)


_STEPS: list[Callable] = [
    lambda e, w, f: _step(e, STEP_1A, w, f), _step_1b, _mend_1b, _step_1c, lambda e, w, f: _step(e, STEP_2, w, f), lambda e, w, f: _step(e, STEP_3, w, f), lambda e, w, f: _step(e, STEP_4, w, f), _step_5a, _step_5b,
]


def letter_form(word: Column) -> Column:
    """v or c for each letter of an ASCII word."""
    letter = lambda form, c: F.when(c.isin(*"aeiou"), "v").when((c == "y") & F.endswith(form, F.lit("c")), "v").otherwise("c")
    return F.aggregate(F.split(word, ""), F.lit(""), lambda form, c: F.concat(form, F.when(c == "", "").otherwise(letter(form, c))))


def stemmed(df: DataFrame, column: str, into: str = "stem") -> DataFrame:
    """df with the Porter stem of a column of lower-case words. Give distinct words: each is worked on once."""
    fits = F.col(column).rlike("^[a-z]{3,64}$")
    out = df.withColumn("_w", F.when(fits, F.col(column)))
    for step in _STEPS:
        out = out.withColumn("_f", letter_form(F.col("_w"))).withColumn("_w", step(_Spark, F.col("_w"), F.col("_f")))
    return out.withColumn(into, F.coalesce("_w", column)).drop("_w", "_f")


def stem_sql(source: str, name: str) -> str:
    """CTEs that end in `name` (term, stem), from `source` (term, distinct words)."""
    out = [f"{name}_0 AS (SELECT term, CASE WHEN regexp_matches(term, '^[a-z]{{3,64}}$') THEN term END AS w FROM {source})"]
    letter = "CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND suffix(f, 'c')) THEN 'v' ELSE 'c' END"
    for k, step in enumerate(_STEPS):
        form = f"list_reduce(list_prepend('', string_split(w, '')), lambda f, c: f || {letter})"
        out.append(f"{name}_{k + 1} AS (SELECT term, {step(_Sql, 'w', 'form')} AS w FROM (SELECT term, w, CASE WHEN w <> '' THEN {form} ELSE '' END AS form FROM {name}_{k}))")
    out.append(f"{name} AS (SELECT term, coalesce(w, term) AS stem FROM {name}_{len(_STEPS)})")
    return ", ".join(out)

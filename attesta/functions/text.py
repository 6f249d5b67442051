"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_norm(text: Column) -> Column:
    """Tokens joined by one blank."""
    return F.array_join(tokens(text), " ")


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether a normalised text holds a normalised phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def keyword_classes(text: Column, classes: dict[str, str], otherwise: str) -> Column:
    """The classes whose keyword the text holds, each once and in order; one class otherwise, also for null."""
    found = F.array(*[F.when(F.contains(text, F.lit(word)), F.lit(c)) for word, c in classes.items()])
    kept = F.array_sort(F.array_distinct(F.filter(found, lambda c: c.isNotNull())))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(otherwise)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each ASCII word, padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def _dihedral(j: int, k: int) -> int:
    """Product in the dihedral group of the pentagon: 0 to 4 turn, 5 to 9 turn and flip."""
    turn = (j % 5 + (k % 5 if j < 5 else -(k % 5))) % 5
    return turn + 5 * ((j < 5) != (k < 5))


def _powers_of(permutation: list[int], n: int) -> list[list[int]]:
    rows = [list(range(len(permutation)))]
    while len(rows) < n:
        rows.append([permutation[x] for x in rows[-1]])
    return rows


#: Verhoeff's scheme, from its rules; fixed value: the permutation.
VERHOEFF_D = "".join(str(_dihedral(j, k)) for j in range(10) for k in range(10))
VERHOEFF_P = "".join(str(x) for row in _powers_of([1, 5, 7, 6, 2, 8, 3, 0, 9, 4], 8) for x in row)


def verhoeff_valid(digits: Column) -> Column:
    """Whether a string of digits ends in its Verhoeff check digit."""
    at = lambda t, i: F.substr(F.lit(t), (i + 1).cast("int"), F.lit(1)).cast("int")
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: at(VERHOEFF_P, (i % 8) * 10 + d.cast("int")))
    return F.aggregate(F.filter(places, lambda p: p.isNotNull()), F.lit(0), lambda c, p: at(VERHOEFF_D, c * 10 + p)) == 0


#: What counts as personal data, in this order.
AADHAAR = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
PII = [
    ("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("PHONE", r"(?<!\d)(?:\+?91[-\s]?)?[6-9]\d{9}(?!\d)"),
]


def scrub_pii(text: Column) -> Column:
    """Personal data replaced by placeholders; twelve digits only with a valid check digit. Text between matches is kept as it is."""
    return reduce(lambda t, p: F.regexp_replace(t, p[1], f"[{p[0]}]"), PII, _without_aadhaar(text))


def _without_aadhaar(text: Column) -> Column:
    matches = F.regexp_extract_all(text, F.lit(AADHAAR), F.lit(0))
    valid = F.filter(F.array_distinct(matches), lambda m: verhoeff_valid(F.regexp_replace(m, r"\s", "")))
    return F.aggregate(valid, text, lambda t, m: F.replace(t, m, F.lit("[AADHAAR]")))


def pii_kinds(text: Column) -> Column:
    """The kinds of personal data that scrub_pii replaces, in its order: AADHAAR once if there is any, the others once for each place. Empty for null."""
    left = _without_aadhaar(text)
    found = [F.when(left != text, F.array(F.lit("AADHAAR"))).otherwise(F.array().cast("array<string>"))]
    for kind, pattern in PII:
        found.append(F.array_repeat(F.lit(kind), F.coalesce(F.regexp_count(left, F.lit(pattern)), F.lit(0))))
        left = F.regexp_replace(left, pattern, f"[{kind}]")
    return F.concat(*found)


def page_clean(text: Column) -> Column:
    """Cut at a footnote rule, drop a leading page number, unwrap amendment brackets, drop runs of asterisks, one blank for white space."""
    body = F.regexp_replace(text, r"(?s)_{10,}.*$", "")
    body = F.regexp_replace(body, r"^\s*\d{1,4}\s*\n", "")
    body = F.regexp_replace(body, r"\d+\[([^\]]*)\]", "$1")
    body = F.regexp_replace(body, r"\*(?:\s*\*)+", " ")
    return F.trim(F.regexp_replace(body, r"\s+", " "))


YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
# a look at the next character first passes over most places of a text
SECTION = r"(?i)(?=[src§])(?<!\w)(?:sections?|rules?|clauses?|sub[\s-]?sections?|secs?\.?|s\.?|§)\s*(\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*)"
DIGITS = r"(?=[\d₹R])(?:\b\d[\d,]*(?:\.\d+)?\s*%?\b|₹\s?\d[\d,]*|(?:Rs\.?)\s?\d[\d,]*)"
HEDGE = r"(?i)(?=[snepu])\b(shall not|no .{0,30} shall|except|unless|provided that|not be|excluding)\b"
#: Number words.
ONES = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
ORDINALS = dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth twentieth thirtieth".split(), [*range(1, 11), 20, 30], strict=True))
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "lakh": 100_000, "crore": 10_000_000}


def _any_of(words: dict[str, int]) -> str:
    """A pattern of whole words, by their first letters: a place is tried against those that begin alike, not against all."""
    tails: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        tails.setdefault(w[0], []).append(w[1:])
    return f"(?=[{''.join(sorted(tails))}])(?:{'|'.join(f'{a}(?:{"|".join(t)})' for a, t in sorted(tails.items()))})"


NUMBER_WORDS = rf"(?i)\b{_any_of({**ONES, **TENS, **MULTIPLIERS, **ORDINALS})}(?:[\s-]{_any_of({**ONES, **TENS, **MULTIPLIERS})})*\b"


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)))


def section_refs(text: Column) -> Column:
    """Distinct references like `section 3(p)`, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(1)), lambda c: F.concat(F.lit("section "), F.lower(c))))


def _fold_words(words: Column) -> Column:
    """The number that a row of number words says: multipliers scale all that is before them, so `two lakh fifty` is 200050 and
    `one lakh two thousand` is 100002000. Null beyond the range of a bigint."""
    plain = F.create_map(*[F.lit(x) for pair in {**ONES, **TENS, **ORDINALS}.items() for x in pair])
    times = F.create_map(*[F.lit(x) for pair in MULTIPLIERS.items() for x in pair])
    scaled = lambda a, w: F.try_multiply(F.when(a == 0, F.lit(1).cast("bigint")).otherwise(a), F.try_element_at(times, w).cast("bigint"))
    step = lambda a, w: F.when(F.map_contains_key(times, w), scaled(a, w)).otherwise(F.try_add(a, F.coalesce(F.try_element_at(plain, w), F.lit(0)).cast("bigint")))
    return F.aggregate(words, F.lit(0).cast("bigint"), step)


def numbers(text: Column) -> Column:
    """Distinct numbers of a text as digits: figures without commas and blanks, ordinals, and number words. Words for a number beyond a bigint are left out."""
    figures = F.transform(F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0)), lambda m: F.regexp_replace(m, r"[,\s]", ""))
    ordinals = F.regexp_extract_all(text, F.lit(r"(?i)\b(\d+)(?:st|nd|rd|th)\b"), F.lit(1))
    phrases = F.regexp_extract_all(text, F.lit(NUMBER_WORDS), F.lit(0))
    words = F.transform(phrases, lambda p: _fold_words(F.split(F.lower(p), r"[\s-]+")).cast("string"))
    return F.array_distinct(F.concat(figures, ordinals, F.filter(words, lambda w: w.isNotNull())))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def named_titles(claim: Column, labels: Column) -> Column:
    """The cited titles that the claim names, with or without a leading `the`, joined by blanks; only titles that hold a year.

    labels: an array of citation labels; a title is what stands before the dash.
    """
    titles = F.transform(labels, lambda x: F.trim(F.split_part(x, F.lit(" — "), F.lit(1))))
    names = lambda t: (t != "") & F.contains(F.lower(claim), F.lower(t))
    return F.array_join(F.filter(titles, lambda t: t.rlike(YEAR) & (names(t) | names(F.regexp_replace(t, r"(?i)^the\s+", "")))), " ")


def numbers_ok(claim: Column, premise: Column, titles: Column | None = None) -> Column:
    """Every number of the claim, section references aside, is in the premise or in the titles that the claim names."""
    bare = lambda t: F.regexp_replace(t, SECTION, " ")
    known = premise if titles is None else F.concat_ws(" ", premise, titles)
    return subset(numbers(bare(claim)), numbers(bare(known)))


def dates_ok(claim: Column, premise: Column, titles: Column | None = None) -> Column:
    return subset(years(claim), years(premise if titles is None else F.concat_ws(" ", premise, titles)))


def cited_locators(section_key: Column) -> Column:
    """`section 25`, `section 25(3)`, `section 25(3)(a)` of a key like `act#s25(3)(a)`: the section and each clause around the cited one, lower-case."""
    clause = F.lower(F.regexp_extract(section_key, r"(?s)^.*#s(\d+[A-Za-z]*(?:\([A-Za-z0-9]+\))*)", 1))
    inner = F.regexp_extract_all(clause, F.lit(r"\([A-Za-z0-9]+\)"), F.lit(0))
    head = F.concat(F.lit("section "), F.regexp_extract(clause, r"^(\d+[A-Za-z]*)", 1))
    return F.when(clause != "", F.transform(F.sequence(F.lit(0), F.size(inner)), lambda i: F.concat(head, F.array_join(F.slice(inner, F.lit(1), i), "")))).otherwise(F.array().cast("array<string>"))


def section_refs_ok(claim: Column, premise: Column, located: Column | None = None) -> Column:
    known = section_refs(premise)
    return subset(section_refs(claim), known if located is None else F.array_union(known, located))


def negation_ok(claim: Column, premise: Column) -> Column:
    """False where the premise hedges and the claim states a bare duty or permission."""
    return ~(premise.rlike(HEDGE) & ~claim.rlike(HEDGE) & claim.rlike(r"(?i)\b(shall|may)\b"))


def modal_ok(claim: Column, premise: Column) -> Column:
    """False where only one side says shall and only the other says may."""
    says = lambda t, w: t.rlike(rf"(?i)\b{w}\b")
    p_shall, p_may, c_shall, c_may = says(premise, "shall"), says(premise, "may"), says(claim, "shall"), says(claim, "may")
    return ~((c_shall & p_may & ~p_shall) | (c_may & p_shall & ~p_may))


def claim_verdict(entailment: Column, claim: Column, premise: Column, titles: Column | None = None, located: Column | None = None) -> Column:
    """verified, partial, or why the claim is dropped. titles: those that the claim names; located: section references that the citations prove."""
    return (
        F.when(entailment < 0.5, "nli_below_threshold").when(~numbers_ok(claim, premise, titles), "unsupported_number").when(~dates_ok(claim, premise, titles), "unsupported_date").when(~section_refs_ok(claim, premise, located), "unsupported_section_reference")
        .when((entailment >= 0.8) & negation_ok(claim, premise) & modal_ok(claim, premise), "verified").otherwise("partial")
    )


def evidence_id(chunk: Column, start: Column, end: Column) -> Column:
    """ev_ and 12 hex digits of sha256(chunk:start:end)."""
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws(":", chunk, start.cast("string"), end.cast("string")), 256), 1, 12))


def section_order(number: Column) -> Column:
    """A number to sort sections by: the digits, and a tenth for each letter of the alphabet up to the first letter after them."""
    letter = F.regexp_extract(number, r"^\d+([A-Z])", 1)
    return F.coalesce(F.try_to_number(F.regexp_extract(number, r"^(\d+)", 1), F.lit("999999999")).cast("double"), F.lit(0.0)) + F.when(letter != "", (F.ascii(letter) - 64) / 10.0).otherwise(0.0)


def is_ancestor(parent: Column, child: Column) -> Column:
    """Whether a path (array) is nonempty, shorter than another and its beginning."""
    return (F.size(parent) > 0) & (F.size(parent) < F.size(child)) & (F.slice(child, F.lit(1), F.size(parent)) == parent)


def embed_text(path: Column, body: Column) -> Column:
    """The heading path over the body; the body alone without a path."""
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n"), body)).otherwise(body)


def citation_label(title: Column, section_key: Column, heading: Column) -> Column:
    """Title and clause, else title and heading, else the title."""
    clause = F.regexp_extract(section_key, r"#s(.+)$", 1)
    return F.when(clause != "", F.concat(title, F.lit(" — s."), clause)).when(F.coalesce(heading, F.lit("")) != "", F.concat(title, F.lit(" — "), heading)).otherwise(title)


def receipt_id(seq: Column, namespace: str | None = None) -> Column:
    return F.concat(F.lit(f"rcp_{namespace}_" if namespace else "rcp_"), seq.cast("string"))


def receipt_seq(receipt: Column, namespace: str | None = None) -> Column:
    """The number in a receipt id; null for what is none, or of another namespace."""
    return F.regexp_extract(receipt, rf"^rcp_{namespace + '_' if namespace else ''}(-?\d{{1,18}})$", 1).try_cast("bigint")


def ticket_id(*parts: Column) -> Column:
    """tkt_ and 12 hex digits of the sha256 of the parts."""
    return F.concat(F.lit("tkt_"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 12))


def mask_terms(text: Column, terms: list[str]) -> Column:
    """A struct (masked, restore): each term of the list that the text holds, in any case, becomes a placeholder; restore maps placeholders back."""
    named = {f"__TERM_{i}__": t for i, t in enumerate(terms)}
    masked = reduce(lambda out, item: F.regexp_replace(out, rf"(?i)\Q{item[1]}\E", item[0]), named.items(), text)
    found = F.array(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), F.struct(F.lit(k).alias("k"), F.lit(t).alias("v"))) for k, t in named.items()]) if named else F.array().cast("array<struct<k:string,v:string>>")
    return F.struct(masked.alias("masked"), F.map_from_entries(F.filter(found, lambda x: x.isNotNull())).alias("restore"))


def unmask(text: Column, restore: Column) -> Column:
    return F.aggregate(F.map_entries(restore), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def segments(text: Column, limit: int = 1800) -> Column:
    """Pieces of at most limit characters at sentence or word ends; only words that are longer themselves are cut. White space between words becomes one blank.

    A text within the limit is one piece as it is.
    """
    none = F.array().cast("array<string>")
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))
    flushed = lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
    joined = lambda a, w: F.when(a["now"] == "", w).otherwise(F.concat(a["now"], F.lit(" "), w))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / limit).cast("int")), lambda i: F.substr(w, i * limit + 1, F.lit(limit)))

    def add_word(a, w):
        return F.when(F.length(w) > limit, state(F.concat(flushed(a), cut(w)), F.lit(""))).when(F.length(joined(a, w)) <= limit, state(a["done"], joined(a, w))).otherwise(state(flushed(a), w))

    def pack(items, step):
        return F.aggregate(items, state(none, F.lit("")), step, flushed)

    sentences = F.split(text, r"(?<=[.!?])\s+|\n+")
    parts = F.flatten(F.transform(sentences, lambda x: pack(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""), add_word)))
    packed = pack(parts, lambda a, x: F.when(F.length(joined(a, x)) <= limit, state(a["done"], joined(a, x))).otherwise(state(flushed(a), x)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def glossary(text: Column, terms: list[tuple[str, dict[str, str]]], lang: str) -> Column:
    """An array of (term, gloss) of the terms that occur in the text and have a gloss in the language; none for English."""
    own = [(t, glosses[lang]) for t, glosses in terms if lang != "en" and glosses.get(lang)]
    rows = [F.when(F.contains(F.lower(text), F.lit(t.lower())), F.struct(F.lit(t).alias("term"), F.lit(g).alias("gloss"))) for t, g in own]
    return F.filter(F.array(*rows), lambda x: x.isNotNull()) if rows else F.array().cast("array<struct<term:string,gloss:string>>")

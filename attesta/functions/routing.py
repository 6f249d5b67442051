"""Routing of questions and parsing of citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of acts and their documents.
ACTS = {
    "patents act": "patents_act_1970",
    "the patents act": "patents_act_1970",
    "patents act, 1970": "patents_act_1970",
    "patents act 1970": "patents_act_1970",
    "patents rules": "patents_rules_2003_consolidated_2021",
    "biological diversity act": "biological_diversity_act_2002",
    "the biological diversity act": "biological_diversity_act_2002",
    "biological diversity act, 2002": "biological_diversity_act_2002",
    "biological diversity act 2002": "biological_diversity_act_2002",
    "biodiversity act": "biological_diversity_act_2002",
    "drugs and cosmetics act": "drugs_cosmetics_act_1940",
    "drugs rules": "drugs_rules_1945_consolidated_2024",
}
#: Fixed value: what a citation looks like; group 1 is the clause, group 2 the act.
CITATION = r"(?i)\b(?:section|sec\.?|s\.|rule|r\.)\s*(\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*)\s*(?:of\s+(?:the\s+)?([a-z][a-z ,\.]+?act|[a-z][a-z ,\.]+?rules))?"
#: Patterns of the router, in the order in which they are tried.
UNRELATED = r"(?i)\b(weather|rain|sports? score|football|cricket|capital of|write (?:me )?a poem|recipe for (?:dinner|cake)|bitcoin price)\b"
LEGAL_ADVICE = r"(?i)\bshould i\b.*\b(file|patent|apply|sue|litigate)\b|\bwill i win\b|\bis (?:this|it) legal for me\b|\bcan you represent me\b|\bwhat should i do\b.*\b(court|sue|lawsuit|litigation)\b"
TK_PATENT = r"(?i)\btraditional knowledge\b.*\bpatent\w*\b|\bpatent\w*\b.*\btraditional knowledge\b"
KEYWORDS = [
    ("classify", r"(?i)\bclassif(y|ication)\b|\bwhat category\b|\bis my (formulation|product) (classical|proprietary|a new drug)\b"),
    ("patent_risk", r"(?i)\bpatent (risk|eligib)|\b3\s*\(\s*[pde]\s*\)\b|\bcan (this|it|my formulation) be patented\b"),
    ("abs", r"(?i)\baccess and benefit sharing\b|\b(abs|nba|sbb|bmc)\b approval|\bbenefit.?shar"),
    ("tk", r"(?i)\btk radar\b|\btkdl\b|\bsimilar (classical )?formulations?\b|\bwatchlist\b"),
    ("dossier", r"(?i)\bdossier\b|\bexport (this|my) (case|results?)\b"),
]
DOMAIN = (
    r"(?i)\b(ayurved\w*|ayush|patent\w*|trademark\w*|copyright|geographical indication|traditional knowledge|biodiversity|biological diversity|biopiracy|benefit.?sharing|"
    r"nba|sbb|bmc|tkdl|tk|wipo|trips|pct|nagoya|cbd|budapest treaty|madrid protocol|hague agreement|plant variet\w*|ppvfr|fssai|cdsco|phytopharmaceutical\w*|"
    r"nutraceutical\w*|aahara?|drug\w*|cosmetic\w*|licen[cs]\w*|regulat\w*|manufactur\w*|formulat\w*|intellectual property|trade secret|design protection|"
    r"herbal|medicinal|botanical|clinical trial\w*|label\w*|export|import)\b"
)


def as_re2(citation: str) -> str:
    """The citation pattern for Java with RE2's meaning, which the SQL has: word bounds of ASCII, blanks without the vertical tab, letters that ignore case beyond ASCII (U+017F is an s, U+212A a k)."""
    first = "(?:s(?<![0-9A-Za-z_].)|\u017f(?<=[0-9A-Za-z_].))(?:ection|ec\\.?|\\.)|r(?<![0-9A-Za-z_].)(?:ule|\\.)"
    same = {r"\b(?:section|sec\.?|s\.|rule|r\.)": f"(?:{first})", r"\s": r"[ \t\n\f\r]", "[A-Za-z]": "[A-Za-z\u017f\u212a]", "[a-zA-Z0-9]": "[a-zA-Z0-9\u017f\u212a]"}
    for old, new in same.items():
        citation = citation.replace(old, new)
    return citation


def citations(text: Column) -> Column:
    """An array of structs (clause, act, section_key) of all citations; the key is null for an act that isn't named or known, and lower-case."""
    pattern = F.lit(as_re2(CITATION))
    acts = F.create_map(*[F.lit(x) for pair in ACTS.items() for x in pair])
    clauses = F.regexp_extract_all(text, pattern, F.lit(1))
    names = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda a: F.nullif(F.regexp_replace(F.lower(F.trim(a)), r"\s+", " "), F.lit("")))
    pairs = F.arrays_zip(clauses.alias("c"), names.alias("a"))
    return F.transform(pairs, lambda p: F.struct(F.lower(p["c"]).alias("clause"), p["a"].alias("act"), F.concat(F.try_element_at(acts, F.coalesce(p["a"], F.lit(""))), F.lit("#s"), F.lower(p["c"])).alias("section_key")))


def route(text: Column, nearest: Column | None = None) -> Column:
    """A struct (intent, section_key): the first pattern that fits decides; nearest is the intent for what no pattern fits."""
    key = F.try_element_at(F.filter(F.transform(citations(text), lambda c: c["section_key"]), lambda k: k.isNotNull()), F.lit(1))
    pair = lambda intent, k=None: F.struct(F.lit(intent).alias("intent") if isinstance(intent, str) else intent.alias("intent"), (F.lit(None).cast("string") if k is None else k).alias("section_key"))
    out = F.when(text.rlike(UNRELATED), pair("out_of_scope")).when(text.rlike(LEGAL_ADVICE), pair("legal_advice")).when(key.isNotNull(), pair("qa", key)).when(text.rlike(TK_PATENT), pair("qa", F.lit("patents_act_1970#s3(p)")))
    for intent, pattern in KEYWORDS:
        out = out.when(text.rlike(pattern), pair(intent))
    return out.when(text.rlike(DOMAIN), pair("qa")).otherwise(pair(F.lit("out_of_scope") if nearest is None else nearest))


def route_with_context(text: Column, context: Column) -> Column:
    """The route of a text; one out of scope, but not plainly unrelated, is tried once more together with the conversation before it."""
    first, again = route(text), route(F.concat(text, F.lit("\nPrior topic: "), context))
    retry = (first["intent"] == "out_of_scope") & (F.coalesce(context, F.lit("")) != "") & ~text.rlike(UNRELATED)
    return F.when(retry, again).otherwise(first)

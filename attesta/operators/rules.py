"""Rule trees compiled to Columns, score roll-ups, intake cascade and set matching."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from attesta.operators import ranking
from attesta.session import materialize

#: The patent-risk tree's conditions and weights, by section of the Act.
PATENT_RISK = [
    {"id": "p_classical_source_match", "section": "3(p)", "cite": ["patents_act_1970#s3(p)"], "weight": 0.5, "when": {"all": [{"field": "classical_sources_cited", "op": "nonempty"}]}},
    {"id": "e_admixture_no_synergy", "section": "3(e)", "cite": ["patents_act_1970#s3(e)"], "weight": 0.4, "when": {"all": [{"field": "ingredients", "op": "len_gte", "value": 2}, {"field": "claims_novel_effect", "op": "eq", "value": False}]}},
    {"id": "d_new_form_no_efficacy", "section": "3(d)", "cite": ["patents_act_1970#s3(d)"], "weight": 0.4, "when": {"all": [{"field": "is_derivative_of_known_substance", "op": "eq", "value": True}]}},
    {"id": "p_no_novel_effect_and_classical", "section": "3(p)", "cite": ["patents_act_1970#s3(p)"], "weight": 0.2, "when": {"all": [{"field": "classical_sources_cited", "op": "nonempty"}, {"field": "claims_novel_effect", "op": "eq", "value": False}]}},
]


def fact_at(path: str) -> Column:
    """A fact by its dotted path: a field of nested structs, or a key of a map; null where a step is missing."""
    head, *rest = path.split(".")
    return reduce(lambda c, name: c[name], rest, F.col(f"`{head}`"))


def condition(tree: dict) -> Column:
    """A tree of all, any, not and leaves {field, op, value} as a Column that is never null: a missing fact makes a leaf false.

    eq and neq take null as a value of its own.
    """
    if "all" in tree:
        return reduce(Column.__and__, map(condition, tree["all"]), F.lit(True))
    if "any" in tree:
        return reduce(Column.__or__, map(condition, tree["any"]), F.lit(False))
    if "not" in tree:
        return ~condition(tree["not"])
    fact, value = fact_at(tree["field"]), F.lit(tree.get("value"))
    length = lambda: F.when(fact.isNotNull(), F.size(fact))
    ops = {
        "eq": lambda: fact.eqNullSafe(value), "neq": lambda: ~fact.eqNullSafe(value), "gte": lambda: fact >= value, "lte": lambda: fact <= value, "nonempty": lambda: length() > 0,
        "empty": lambda: F.coalesce(length(), F.lit(0)) == 0, "len_gte": lambda: length() >= value, "contains": lambda: F.array_contains(fact, value),
    }
    return F.coalesce(ops[tree["op"]](), F.lit(False))


def rule_hits(facts: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """key, rule_id, section and weight of each rule that holds: one pass over the facts, no join."""
    hits = F.array(*[F.when(condition(r["when"]), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["section"]).alias("section"), F.lit(float(r["weight"])).alias("weight"))) for r in rules])
    return facts.select(key, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "h.rule_id", "h.section", "h.weight")


def gauge(score: Column, low: float = 0.34, high: float = 0.67) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")


def risk_rollup(facts: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """key, score (sum over sections, 1 at most), level and the sorted rule ids; facts without a hit score 0."""
    hits = rule_hits(facts, rules, key).groupBy(key).agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum("weight"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    every = facts.select(key).join(hits, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rules", F.lit("")).alias("rules"))
    return every.withColumn("level", gauge(F.col("score")))


def intake(answers: str = "answers") -> Column:
    """Outcome of a map of intake answers: the first group of questions that still needs one (q_...), or a category.

    Groups are asked in order; a missing, blank, unknown or unlisted answer asks its group, and so do contradictions.
    """
    a = lambda k: F.trim(F.coalesce(F.try_element_at(F.col(answers), F.lit(k)), F.lit("")))
    free = lambda k: (a(k) == "") | a(k).isin("unknown", "ambiguous", "other")
    listed = lambda k, *of: free(k) | ~a(k).isin(*of)
    yes_no = lambda k: listed(k, "yes", "no")
    use, route, match = a("intended_use"), a("route"), a("classical_match")
    medicinal = (use == "medicine") | (a("therapeutic_claims") == "yes")
    ask_use = listed("intended_use", "medicine", "food", "cosmetic") | yes_no("therapeutic_claims") | free("claims_text") | use.isin("food", "cosmetic") & (a("therapeutic_claims") == "yes")
    ask_route = listed("route", "oral", "topical", "parenteral") | free("dosage_form")
    ask_match = listed("classical_match", "exact", "modified", "none") | free("classical_reference") | (match == "exact") & F.lower(a("classical_reference")).isin("none", "n/a", "no")
    ask_more = free("ingredients") | yes_no("novelty") | free("novelty_details") | yes_no("purified_fraction") | medicinal & (yes_no("authoritative_ingredients") | yes_no("four_markers"))
    new = (a("novelty") == "yes") | (a("authoritative_ingredients") == "no")
    return (
        F.when(ask_use, "q_use_claims").when(ask_route, "q_route_dosage").when(ask_match, "q_classical_match").when(ask_more, "q_ingredients_extract")
        .when(use == "cosmetic", F.when(route != "topical", "q_route_dosage").otherwise("cosmetic"))
        .when(use == "food", F.when(route != "oral", "q_route_dosage").otherwise("aahar_nutraceutical"))
        .when(a("purified_fraction") == "yes", F.when((a("four_markers") == "yes") & (route != "parenteral"), "phytopharmaceutical").otherwise("new_drug"))
        .when(a("four_markers") == "yes", "q_ingredients_extract")
        .when(match == "exact", F.when(new, "q_classical_match").otherwise("classical"))
        .when(new | (route == "parenteral"), "new_drug").otherwise("proprietary")
    )


def set_match(left: str, right: str, boosted: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0.15 more if boosted, 1 at most."""
    union = F.size(F.array_union(left, right))
    base = F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + F.when(boosted, 0.15).otherwise(0.0)), 2)


def confidence(df: DataFrame, margin: str, entailment: str, verified: str, back_translated: str, weight: float = 0.25, low: float = 0.35, high: float = 0.60) -> DataFrame:
    """df with score, level, abstain and review. An unchecked back-translation counts half."""
    back = F.when(F.col(back_translated), 1.0).otherwise(0.5)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight * (F.col(margin) + F.col(entailment) + F.col(verified) + back))), 6)
    out = df.withColumn("score", score)
    return out.withColumn("level", F.when(F.col("score") < low, "low").when(F.col("score") < high, "medium").otherwise("high")).withColumn("abstain", F.col("score") < low).withColumn("review", (F.col("score") >= low) & (F.col("score") < high))


def _letters(names: DataFrame, name: str, lowered: str) -> DataFrame:
    """name and t for each letter of a name; the second a of a name is another member than the first."""
    each = names.select(name, F.explode(F.split(lowered, "")).alias("c")).where("c <> ''").groupBy(name, "c").agg(F.count("*").cast("int").alias("n"))
    return each.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat("c", k.cast("string")))).alias("t"))


def fuzzy_names(names: DataFrame, dictionary: DataFrame, name: str, entry: str, least: float = 0.6, k: int = 3, counted: dict | None = None) -> DataFrame:
    """name, entry and ratio: equal names (case aside) win alone, else the k most similar entries of ratio `least` or more.

    The ratio is that of longest matching blocks (difflib) over distinct names and entries. It counts characters in common, so it is at most
    twice the common letters over the sum of lengths, repeated letters included. Pairs that may reach it by that bound are found by the prefixes
    of the multisets of letters, rare ones first (prefix_candidates); matching blocks are run on these only. counted, if given, gets their
    number. Null names match nothing; the empty name equals the empty entry alone.
    """
    import difflib

    n = names.select(F.col(name).alias("_n"), F.lower(name).alias("_ln")).where("_n IS NOT NULL").distinct()
    d = dictionary.select(F.col(entry).alias("_e"), F.lower(entry).alias("_le")).where("_e IS NOT NULL").distinct()
    same = n.join(d, F.col("_ln") == F.col("_le")).select(F.col("_n").alias(name), F.col("_e").alias(entry), F.lit(1.0).alias("ratio"))
    left = n.join(same.select(F.col(name).alias("_n")).distinct(), "_n", "left_anti").where(F.length("_ln") > 0)
    of_entries = materialize(_letters(d, "_e", "_le"), "letters")
    rank = of_entries.groupBy("t").agg(F.count("*").alias("df")).select("t", F.struct("df", "t").alias("rank"))
    ordered = lambda each, key: each.join(ranking.small(rank), "t", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.coalesce("rank", F.struct(F.lit(0).cast("bigint").alias("df"), F.col("t").alias("t"))))).alias("r"))
    asked, known = ordered(_letters(left, "_n", "_ln"), "_n").withColumnRenamed("_n", "query_id"), ordered(of_entries, "_e").select(F.col("_e").alias("section_id"), F.lit(0).alias("f"), "r")
    share = least / (2 - least) - 1e-9  # of the union, if the ratio is `least`
    found = materialize(ranking.prefix_candidates(asked, known, F.lit(share), share), "name-pairs")
    if counted is not None:
        counted["pairs"] = found.count()
    pairs = found.select(F.col("query_id").alias("_n"), F.col("section_id").alias("_e"), F.lower("query_id").alias("_ln"), F.lower("section_id").alias("_le"))

    @F.arrow_udf(DoubleType())
    def ratio(left: pa.Array, right: pa.Array) -> pa.Array:
        m, out, last = difflib.SequenceMatcher(), [], None
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            if a != last:
                m.set_seq2(a)
                last = a
            m.set_seq1(b)
            close = m.real_quick_ratio() >= least and m.quick_ratio() >= least
            out.append(m.ratio() if close else 0.0)
        return pa.array(out, pa.float64())

    near = pairs.withColumn("ratio", ratio("_ln", "_le")).where(F.col("ratio") >= least)
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("ratio"), "_e"))).where(F.col("_r") <= k)
    return same.unionByName(ranked.select(F.col("_n").alias(name), F.col("_e").alias(entry), F.round("ratio", 6).alias("ratio")))

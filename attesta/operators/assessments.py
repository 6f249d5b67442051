"""Assessments of formulations: risk cards, categories and their support, checklists, citations and matches with known formulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions.text import evidence_id
from attesta.operators.gate import valid_on
from attesta.operators.ranking import meet
from attesta.operators.rules import gauge, rule_hits, set_match

#: Sections of the risk card in their order, what their rules say and cite, and what would help.
RISK_SECTIONS = ["3(p)", "3(e)", "3(d)"]
HELP = {
    "3(d)": "Comparative data showing enhanced efficacy over the known substance.",
    "3(p)": "Evidence of a technical effect not disclosed in the cited classical source.",
}
#: The provision that defines each category.
DEFINING = {
    "classical": "drugs_cosmetics_act_1940#s3(a)",
    "proprietary": "drugs_cosmetics_act_1940#s3(h)(i)",
    "new_drug": "new_drugs_clinical_trials_rules_2019#s2(w)",
    "phytopharmaceutical": "drugs_rules_1945_consolidated_2024#s2(ec)",
    "cosmetic": "drugs_cosmetics_act_1940#s3(aaa)",
    "aahar_nutraceutical": "fssai_ayurveda_aahara_regulations_2022#s2(b)",
}
#: Topics of the benefit-sharing checklist: activities that raise one, and the sections that it cites.
ABS_ACT = "biological_diversity_act_2002"
ABS_TOPICS = {
    "access": (["research", "commercial_utilisation"], ["3", "7"]),
    "ipr": (["ipr_application"], ["6"]),
    "transfer": (["transfer_results", "export"], ["4", "20"]),
    "trade": (["cultivation_trade"], ["7", "40"]),
}


def risk_sections(facts: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """key, section, position, score, risk, rules and cites (sorted) for every section of the card; sections without a hit score 0."""
    cites = F.create_map(*[F.lit(x) for r in rules for x in (r["id"], "|".join(r.get("cite", [])))])
    hits = rule_hits(facts, rules, key).withColumn("_c", F.split(F.try_element_at(cites, F.col("rule_id")), r"\|"))
    found = hits.groupBy(key, "section").agg(F.round(F.sum("weight"), 6).alias("score"), F.array_sort(F.collect_set("rule_id")).alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_c")))).alias("cites"))
    every = facts.select(key, F.posexplode(F.array(*map(F.lit, RISK_SECTIONS))).alias("position", "section"))
    none = F.array().cast("array<string>")
    out = every.join(found, [key, "section"], "left")
    return out.select(key, "section", "position", F.coalesce("score", F.lit(0.0)).alias("score"), gauge(F.coalesce("score", F.lit(0.0))).alias("risk"), F.coalesce("rules", none).alias("rules"), F.filter(F.coalesce("cites", none), lambda c: c != "").alias("cites"))


def risk_card(facts: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """key, score (1 at most), gauge, help (texts for sections that aren't low) and path (nodes and edges of the decision, in order)."""
    s = F.col("s")
    rows = risk_sections(facts, rules, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "section", "score", "risk", "rules"))).alias("s"))
    total = F.round(F.least(F.lit(1.0), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"])), 6)
    raised = F.transform(F.filter("s", lambda x: x["risk"] != "low"), lambda x: x["section"])
    helps = F.filter(F.array(*[F.when(F.array_contains(raised, name), text) for name, text in HELP.items()]), lambda x: x.isNotNull())
    carded = rows.select(key, "s", total.alias("score"), helps.alias("help")).withColumn("gauge", gauge(F.col("score")))
    steps = F.transform(s, lambda x: F.struct(F.concat(F.lit("n_"), F.regexp_replace(x["section"], r"[()]", "")).alias("id"), F.when(F.size(x["rules"]) > 0, "yes").otherwise("no").alias("value")))
    return carded.select(key, "score", "gauge", "help", decision_path(steps, F.concat(F.lit("Overall patent risk: "), "gauge"), F.col("gauge")).alias("path"))


def decision_path(steps: Column, outcome: Column, last: Column | None = None) -> Column:
    """A struct (nodes, edges) of a line of questions (structs id, value) that ends in an outcome; an edge bears the value of the node it leaves, the last one `last` if given."""
    ends = F.transform(F.slice(steps, F.lit(2), F.size(steps)), lambda x: x["id"])
    to = F.concat(ends, F.array(F.lit("outcome")))
    edges = F.transform(F.arrays_zip(steps.alias("s"), to.alias("t")), lambda x, i: F.struct(x["s"]["id"].alias("src"), x["t"].alias("dst"), (F.when(i == F.size(steps) - 1, last).otherwise(x["s"]["value"]) if last is not None else x["s"]["value"]).alias("label")))
    return F.struct(F.concat(steps, F.array(F.struct(F.lit("outcome").alias("id"), outcome.alias("value")))).alias("nodes"), edges.alias("edges"))


def resolve_citations(asked: DataFrame, sections: DataFrame, chunks: DataFrame, documents: DataFrame, descendants: bool = False) -> DataFrame:
    """asked (its key columns, cite, jurisdictions, as_of) with the spans that each cite leads to: section_key, chunk_id, evidence_id, citation_label.

    A key that isn't in the corpus leads nowhere. With descendants, keys that go on with `(` or `-` are led to as well; the key up to its first
    `(` or `-` is the join key, so no key is compared with all others. Chunks pass the gate of the request.
    sections: section_key, section_id, document_id; chunks: section_id, chunk_id, jurisdiction, valid_from, valid_to, char_start, char_end; documents: document_id, title.
    """
    root = lambda c: F.regexp_extract(c, r"^([^#]*#[^(-]*)", 1)
    keyed = sections.select(root(F.col("section_key")).alias("_root"), "section_key", "section_id", "document_id")
    met = asked.withColumn("_root", root(F.col("cite"))).join(keyed, "_root").drop("_root")
    same = F.col("section_key") == F.col("cite")
    met = met.where(same | F.col("section_key").startswith(F.concat("cite", F.lit("("))) | F.col("section_key").startswith(F.concat("cite", F.lit("-"))) if descendants else same)
    held = met.join(chunks, "section_id").where(F.array_contains("jurisdictions", F.col("jurisdiction")) & valid_on(F.col("as_of"))).join(documents, "document_id")
    label = F.concat("title", F.lit(" — "), F.regexp_extract("section_key", r"#(.*)$", 1))
    return held.select(*asked.columns, "section_key", "chunk_id", evidence_id(F.col("chunk_id").cast("string"), F.col("char_start"), F.col("char_end")).alias("evidence_id"), label.alias("citation_label"))


def category_support(categories: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, category and supported: whether the evidence (key, section_key) holds the provision that defines the category; a draft otherwise."""
    defining = F.try_element_at(F.create_map(*[F.lit(x) for pair in DEFINING.items() for x in pair]), F.col("category"))
    held = evidence.select(F.col(key).alias("_k"), F.col("section_key").alias("_s")).distinct()
    asked = categories.withColumn("_d", defining)
    return asked.join(held, (asked[key] == held["_k"]) & (asked["_d"] == held["_s"]), "left").select(key, "category", F.col("_s").isNotNull().alias("supported"))


def abs_checklist(requests: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, topic, evidence_ids (sorted) and assessed (always null: a checklist determines nothing) for each topic that an activity raises.

    requests: key, activities (array); evidence: key, section_key, evidence_id. A span belongs to a topic if its key is one of the topic's
    sections or goes on from it with `(` or `-`.
    """
    topics = F.array(*[F.struct(F.lit(t).alias("topic"), F.arrays_overlap("activities", F.array(*map(F.lit, a))).alias("on"), F.array(*[F.lit(f"{ABS_ACT}#s{n}") for n in numbers]).alias("cites")) for t, (a, numbers) in ABS_TOPICS.items()])
    raised = requests.select(key, F.explode(F.filter(topics, lambda t: t["on"])).alias("t")).select(key, "t.topic", F.explode("t.cites").alias("cite"))
    spans = evidence.withColumn("cite", F.regexp_extract("section_key", r"^([^#]*#[^(-]*)", 1))
    joined = raised.join(spans.select(key, "cite", "evidence_id"), [key, "cite"], "left")
    return joined.groupBy(key, "topic").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids")).withColumn("assessed", F.lit(None).cast("boolean"))


def canonical_names(ingredients: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, name and canonical: the entry that an ingredient's name equals in any case; names without one are dropped. names: name, canonical (the first of several counts)."""
    first = names.select(F.lower("name").alias("_n"), "canonical").groupBy("_n").agg(F.min("canonical").alias("canonical"))
    return ingredients.withColumn("_n", F.lower("name")).join(first, "_n").select(key, "name", "canonical")


def formulation_matches(asked: DataFrame, known: DataFrame, k: int = 8) -> DataFrame:
    """ask, ref, score, overlap, missing, extra (sorted sets), indication_match and rank: the k best known formulations that share an ingredient.

    asked: ask, items (array), indication; known: ref, items, indications (array). A match of the indication adds 0.15. Pairs come from an
    equi-join on ingredients and are counted once; the asking side is broadcast if it is small, else an ingredient's postings are dealt to salts.
    """
    of_known, of_asked = known.select("ref", F.explode(F.array_distinct("items")).alias("x")), asked.select("ask", F.explode(F.array_distinct("items")).alias("x"))
    pairs = meet(of_known, of_asked, ["x"], "ref").select("ask", "ref").distinct()
    joined = pairs.join(asked.select("ask", F.col("items").alias("_a"), "indication"), "ask").join(known.select("ref", F.col("items").alias("_r"), "indications"), "ref")
    boosted = F.coalesce((F.coalesce("indication", F.lit("")) != "") & F.exists("indications", lambda i: F.contains(F.lower(i), F.lower(F.col("indication")))), F.lit(False))
    scored = joined.withColumn("indication_match", boosted).withColumn("score", set_match("_a", "_r", F.col("indication_match")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "ref"))).where(F.col("rank") <= k)
    sorted_ = lambda c: F.array_sort(F.array_distinct(c))
    return ranked.select("ask", "ref", "score", sorted_(F.array_intersect("_a", "_r")).alias("overlap"), sorted_(F.array_except("_r", "_a")).alias("missing"), sorted_(F.array_except("_a", "_r")).alias("extra"), "indication_match", "rank")


def watchlist_hits(asked: DataFrame, cases: DataFrame) -> DataFrame:
    """ask and case: cases whose species (array) share a canonical name with the asked items; by an equi-join."""
    return asked.select("ask", F.explode("items").alias("x")).join(cases.select("case", F.explode("species").alias("x")), "x").select("ask", "case").distinct()


def tk_radar(formulations: DataFrame, names: DataFrame, known: DataFrame, cases: DataFrame) -> DataFrame:
    """ask, canonical (sorted), terms (the canonical names, then names that aren't known, each once), matches (scores over 0, best first) and watchlist.

    formulations: ask, items (array of names), indication.
    """
    named = formulations.select("ask", F.posexplode("items").alias("at", "name"))
    met = canonical_names(named.select("ask", "name").distinct(), names, "ask")
    terms = named.join(met, ["ask", "name"], "left").groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical", "name").alias("t")))).alias("t"), F.array_sort(F.collect_set("canonical")).alias("canonical"))
    asked = terms.select("ask", "canonical", F.array_distinct(F.transform("t", lambda x: x["t"])).alias("terms")).join(formulations.select("ask", "indication"), "ask")
    items = asked.select("ask", F.col("canonical").alias("items"), "indication")
    best = formulation_matches(items, known).where("score > 0").groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("rank", "ref", "score"))).alias("matches"))
    watch = watchlist_hits(items, cases).groupBy("ask").agg(F.array_sort(F.collect_set("case")).alias("watchlist"))
    return asked.join(best, "ask", "left").join(watch, "ask", "left").select(
        "ask", "canonical", "terms", F.coalesce(F.transform("matches", lambda m: F.struct(m["ref"].alias("ref"), m["score"].alias("score"))), F.array()).alias("matches"), F.coalesce("watchlist", F.array()).alias("watchlist"))

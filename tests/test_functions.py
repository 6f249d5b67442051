"""Expected values of text, language and payload functions, claims, history, sources and assessments."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import language as lg
from attesta.functions import payload as pl
from attesta.functions import routing
from attesta.functions import text as tx
from attesta.operators import assessments as am
from attesta.operators import claims as cl
from attesta.operators import gate, graph, history, integrity, quality, ranking, rules, structure
from attesta.sources import files


def many(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict()


def test_numbers_beyond_every_type(spark):
    n = lambda t: F.array_sort(tx.numbers(F.lit(t)))
    got = many(spark, a=n("nine hundred crore"), b=n("one lakh two thousand"), c=n("crore crore crore"), d=n("two hundred fifty"), e=tx.numbers(F.lit(None).cast("string")))
    assert got["a"] == ["9000000000"] and got["b"] == ["100002000"] and got["c"] == [] and got["d"] == ["250"]


def test_locators_titles_and_labels(spark):
    labels = F.array(F.lit("The Patents Act, 1970 — s.3"), F.lit("Rules — s.1"))
    got = many(
        spark, a=tx.cited_locators(F.lit("act#s25(3)(A)")), b=tx.cited_locators(F.lit("act#r5")), c=tx.named_titles(F.lit("under the patents act, 1970 only"), labels), d=tx.named_titles(F.lit("nothing"), labels),
        e=tx.citation_label(F.lit("T"), F.lit("d#s3(p)"), F.lit("H")), f=tx.citation_label(F.lit("T"), F.lit("d#r3"), F.lit("H")), g=tx.citation_label(F.lit("T"), F.lit("d#r3"), F.lit(None).cast("string")),
        h=tx.dates_ok(F.lit("the Patents Act, 1970 says"), F.lit("x"), tx.named_titles(F.lit("the Patents Act, 1970 says"), labels)), i=tx.receipt_seq(F.lit("rcp_12")), j=tx.receipt_seq(F.lit("rcp_ns_12"), "ns"), k=tx.receipt_seq(F.lit("x")), l=tx.receipt_id(F.lit(5), "ns"))
    assert got["a"] == ["section 25", "section 25(3)", "section 25(3)(a)"] and got["b"] == []
    assert got["c"] == "The Patents Act, 1970" and got["d"] == "" and (got["e"], got["f"], got["g"]) == ("T — s.3(p)", "T — H", "T")
    assert got["h"] and (got["i"], got["j"], got["k"], got["l"]) == (12, 12, None, "rcp_ns_5")


def by_words(text, limit):
    """Segments by a plain loop over words."""
    import re

    if len(text) <= limit:
        return [text]
    parts = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        now = ""
        for w in sentence.split():
            if len(w) > limit:
                parts += [now] if now else []
                parts += [w[i:i + limit] for i in range(0, len(w), limit)]
                now = ""
            elif not now or len(now) + len(w) + 1 <= limit:
                now = f"{now} {w}".strip()
            else:
                parts.append(now)
                now = w
        parts += [now] if now else []
    out, now = [], ""
    for p in parts:
        if now and len(now) + 1 + len(p) > limit:
            out.append(now)
            now = p
        else:
            now = f"{now} {p}".strip()
    return out + ([now] if now else [])


def test_segments_masks_and_glossaries(spark):
    texts = ["short", "One two. Three four five! " + "x" * 47 + " six\nseven eight nine ten eleven", "a" * 95, "w " * 60]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.segments(F.col("t"), 20).alias("s")).collect()
    assert [r.s for r in got] == [by_words(r.t, 20) for r in got] and all(len(x) <= 20 for r in got for x in r.s)
    m = many(spark, m=tx.mask_terms(F.lit("The PATENT (a.b) patent"), ["patent", "a.b", "none"]))["m"]
    assert m.masked == "The __TERM_0__ (__TERM_1__) __TERM_0__" and m.restore == {"__TERM_0__": "patent", "__TERM_1__": "a.b"}
    got = many(spark, u=tx.unmask(F.lit(m.masked), F.create_map(*[F.lit(x) for p in m.restore.items() for x in p])), g=tx.glossary(F.lit("A Patent"), [("patent", {"hi": "x"}), ("act", {"hi": "y"})], "hi"), e=tx.glossary(F.lit("A Patent"), [("patent", {"hi": "x"})], "en"))
    assert got["u"] == "The patent (a.b) patent" and [tuple(x) for x in got["g"]] == [("patent", "x")] and got["e"] == []


def test_languages(spark):
    say = lambda t: lg.language(F.lit(t))
    got = many(spark, a=say("the end of the road"), b=say("le chat est dans la maison"), c=say("der Hund und die Katze"), d=say("el perro y los gatos"), e=say("यह हिंदी है"), f=say(""), g=lg.language(F.lit("der Hund"), ("en", "fr")), h=lg.language(F.lit("x"), requested=F.lit("ta")))
    assert list(got.values()) == ["en", "fr", "de", "es", "hi", "en", "en", "ta"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200")
    assert docs.select(F.avg((lg.language(F.col("text"), ("en", "fr", "de", "es")) == F.col("lang")).cast("double"))).first()[0] > 0.6


def test_canonical_json_and_payloads(spark):
    value = {"b": [1, 2.5, None], "a": {"é": "ü", "z": True}}
    got = many(
        spark, c=pl.canonical_json(F.lit(json.dumps(value))), bad=pl.canonical_json(F.lit("{")), s=pl.result_summary(F.lit('{"sections":[{"claims":[{"text":"x"},{"text":"y"}]},{}],"message":"m"}')), t=pl.result_summary(F.lit('{"type":"abs"}')), u=pl.result_summary(F.lit("{}")),
        k=pl.unknown_keys(F.lit('{"a":1,"zz":2}'), ["a"]), f=pl.field_at(F.lit('{"a":{"b":"x"}}'), "a.b", "int"), w=pl.within_bounds(F.lit(""), F.array(F.lit("E1"))), x=pl.within_bounds(F.lit("s"), F.array(F.lit("E1"))))
    assert got["c"] == json.dumps(value, sort_keys=True, separators=(",", ":")) and got["bad"] is None
    assert (got["s"], got["t"], got["u"], got["k"], got["f"], got["w"], got["x"]) == ("x\ny", "abs", "Result", ["zz"], None, False, True)
    df = spark.sql("select struct('a@b.org' as text, array('a@b.org') as evidence, map('k', 'a@b.org', 'evidence', 'a@b.org') as m, 5 as n) as p union all select null")
    rows = [r.p for r in pl.scrub_payload(df, ["p"]).collect()]
    assert rows[0].text == "[EMAIL]" and rows[0].evidence == ["a@b.org"] and rows[0].m == {"k": "[EMAIL]", "evidence": "a@b.org"} and rows[0].n == 5 and rows[1] is None


def test_context_gives_a_second_try(spark):
    r = lambda t, c: routing.route_with_context(F.lit(t), F.lit(c))["intent"]
    got = many(spark, a=r("and what about that", "herbal licence"), b=r("weather today", "herbal licence"), c=r("and that", ""), d=r("patent risk", "x"))
    assert list(got.values()) == ["qa", "out_of_scope", "out_of_scope", "patent_risk"]


PACK = "query_id int, number int, evidence_id string, jurisdiction string, doc_id string, corpus_version string, section_key string, section_path array<string>, citation_label string, text string"


@pytest.fixture
def pack(spark):
    rows = [(1, 1, "e1", "IN", "d", "v", "d#s3", ["S3"], "Act 1970 — s.3", "Inventions."), (1, 2, "e2", "IN", "d", "v", "d#s3(p)", ["S3", "p"], "Act 1970 — s.3(p)", "File within thirty days."), (1, 3, "e3", "INTL", "t", "v", "t#art1", ["A1"], "Treaty — art", "Other.")]
    return spark.createDataFrame(rows, PACK)


def test_claims_are_resolved_and_checked(spark, pack):
    rows = [(1, 1, "File within 30 days under section 3(p) of the Act 1970", ["E2"], 0.9), (1, 2, "x", ["E9"], 0.9), (1, 3, "x", ["E1", "e3"], 0.9), (1, 4, "File within 60 days", [" e2 "], 0.9), (1, 5, "Inventions", ["E1"], 0.6), (1, 6, "Inventions", ["E1"], 0.1), (2, 1, "x", ["E1"], 0.9), (1, 7, "x", [], 0.9)]
    claims = spark.createDataFrame(rows, "query_id int, claim_no int, statement string, evidence_ids array<string>, entailment double")
    resolved = cl.resolve_claims(claims, pack)
    got = {(r.query_id, r.claim_no): (r.dropped, r.resolved) for r in resolved.collect()}
    assert got[1, 2][0] == got[2, 1][0] == got[1, 7][0] == "unknown_reference" and got[1, 3][0] == "mixed_jurisdictions" and got[1, 4] == (None, ["e2"])
    checked = cl.verify_claims(cl.with_parents(resolved, pack), pack)
    verdicts = {r.claim_no: (r.verdict, r.cited) for r in checked.collect()}
    assert verdicts == {1: ("verified", ["e1", "e2"]), 4: ("unsupported_number", ["e1", "e2"]), 5: ("partial", ["e1"]), 6: ("nli_below_threshold", ["e1"])}
    out = cl.verification_outcome(checked).first()
    assert (out.kept, out.dropped, out.drop_reasons, out.review) == (2, 2, {"unsupported_number": 1, "nli_below_threshold": 1}, True) and out.mean_entailment == pytest.approx(0.75) and out.verified_ratio == 0.25
    assert {r.evidence_id for r in cl.cited_only(pack, checked).collect()} == {"e1", "e2"}
    asked = spark.createDataFrame([(1, ["INTL", "IN"], ["g"])], "query_id int, jurisdictions array<string>, gaps array<string>")
    sections = {r.jurisdiction: (r.position, r.claims, r.gaps) for r in cl.answer_sections(checked, pack, asked).collect()}
    assert sections == {"INTL": (0, [], ["g"]), "IN": (1, ["File within 30 days under section 3(p) of the Act 1970", "Inventions"], [])}
    assert cl.prompts(pack).first().prompt.startswith("[E1] Act 1970 — s.3 [IN]\nS3\nInventions.\n\n[E2]")


def test_receipts_prove_and_notice_changes(spark):
    import hashlib

    texts = {1: "one", 2: "two", 3: "three"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(1, i, f"r{i}", "v", sha("q"), [(f"e{i}", i, sha(texts[i]))], ("none",), "p1", json.dumps({"message": f"é{i}", "receipt_id": ""}), None, "t") for i in (1, 2, 3)]
    results = spark.createDataFrame(rows, "log int, seq int, request_id string, corpus_version string, query_hash string, spans array<struct<evidence_id:string,chunk_id:int,sha256:string>>, model_ids struct<llm:string>, prompt_version string, result string, request string, ts string")
    receipts = integrity.build_receipts(results, "log", "seq").cache()
    prev = "0" * 64
    for r in receipts.orderBy("seq").collect():
        i = r.seq
        entry = {
            "request_id": f"r{i}", "corpus_version": "v", "query_hash": sha("q"), "chunk_hashes": [sha(texts[i])], "spans": [{"evidence_id": f"e{i}", "chunk_id": i, "sha256": sha(texts[i])}], "model_ids": {"llm": "none"}, "prompt_version": "p1",
            "result_hash": sha(json.dumps({"message": f"é{i}", "receipt_id": ""}, sort_keys=True, separators=(",", ":"))), "result_receipt_field": "", "request_payload_hash": None, "ts": "t"}
        assert json.loads(r.entry) == entry and r.entry == json.dumps(entry, sort_keys=True, separators=(",", ":"))
        assert r.prev_hash == prev and r.entry_hash == sha(prev + r.entry) and r.receipt_id == f"rcp_{i}"
        prev = r.entry_hash
    chunks = spark.createDataFrame([("v", k, t + ("!" if k == 2 else ""), sha(t)) for k, t in texts.items() if k != 3], "corpus_version string, chunk_id int, text string, sha256 string")
    roots = integrity.merkle_roots(chunks, "corpus_version", "chunk_id", "sha256")
    chained, spans = integrity.verify_receipts(receipts.withColumn("entry", F.when(F.col("seq") == 3, "x").otherwise(F.col("entry"))), "log", "seq", chunks, roots)
    assert {r.seq: r.chain_valid for r in chained.collect()} == {1: True, 2: True, 3: False}
    assert {r.evidence_id: (r.in_corpus, r.proof_valid) for r in spans.collect()} == {"e1": (True, True), "e2": (True, False), "e3": (False, False)}
    stored = spark.createDataFrame([("r1", json.dumps({"receipt_id": "rcp_1", "message": "é1"})), ("r2", json.dumps({"receipt_id": "rcp_2", "message": "edited"})), ("r9", "{}")], "request_id string, result string")
    assert {r.request_id: r.integrity for r in integrity.result_integrity(stored, receipts).collect()} == {"r1": "ok", "r2": "mismatch", "r9": "missing"}


def test_chains_stream_null_keys_and_payloads(spark):
    import hashlib

    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), (1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "k int, s int, p string")
    got = {(r.k, r.s): (r.prev_hash, r.entry_hash) for r in integrity.chain(df, "k", "s", "p").collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    a = h("0" * 64 + "a")
    assert got[None, 1] == got[1, 1] == ("0" * 64, a) and got[None, 2] == (a, h(a)) and got[1, 3] == (h(a + "b"), h(h(a + "b") + "c"))
    assert integrity.chain(df.where("1 = 0"), "k", "s", "p").collect() == []
    n = integrity.numbered(spark.createDataFrame([("t", i) for i in range(100)] + [("u", 5)], "k string, o int"), "k", "o").collect()
    assert all(r.i == (r.o if r.k == "t" else 0) for r in n) and len(n) == 101


def test_promotion_checks(spark):
    ok = ("v", "staged", "R", "h", "h", 0, 0.9, 0, "r", "r", "g", "g", "m", "m", 0)
    schema = "version string, status string, reviewer string, approved_hash string, report_hash string, issues int, recall double, leaks int, root string, stored_root string, golden string, stored_golden string, manifest string, stored_manifest string, changed_files int"
    fails = lambda **change: {r.failed for r in integrity.promotion_failures(spark.createDataFrame([tuple(change.get(n.split()[0], v) for n, v in zip(schema.split(", "), ok, strict=True))], schema)).collect()}
    assert fails() == set() and fails(reviewer=" ") == {"approval"} and fails(recall=None) == {"recall"} and fails(golden=None, leaks=1) == {"golden", "leaks"}
    versions = spark.createDataFrame([("v", "staged"), ("w", "live")], "version string, status string")
    none = spark.createDataFrame([], "version string, failed string")
    assert {tuple(r) for r in integrity.promote(versions, none, "v").collect()} == {("v", "live"), ("w", "retired")}
    assert {tuple(r) for r in integrity.promote(versions, spark.createDataFrame([("v", "root")], none.schema), "v").collect()} == {("v", "staged"), ("w", "live")}


def test_sources_are_committed_whole(spark, tmp_path):
    one = spark.createDataFrame([(1, "v", 7)], "k int, version string, document_id int")
    tables = {n: one for n in files.TABLES}
    files.write_source(tables, str(tmp_path / "c"), "v", "s")
    files.write_source({**tables, "chunks": one.union(one)}, str(tmp_path / "c"), "v", "s")
    assert files.read_source_tables(spark, str(tmp_path / "c"), "v", "chunks").count() == 2
    with pytest.raises(ValueError, match="a source has the tables"):
        files.write_source({"chunks": one}, str(tmp_path / "c"), "v", "s")
    out = files.export_version({"sections": one, "documents": spark.createDataFrame([(7,), (8,)], "document_id int")}, "v")
    assert [r.document_id for r in out["documents"].collect()] == [7]
    files.write_report(spark.createDataFrame([("a", 1)], "x string, n int"), str(tmp_path / "r"), "Title")
    assert [r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect()] == ["# Title", "", "| x | n |", "| --- | --- |", "| a | 1 |"]
    (tmp_path / "m.yaml").write_text("sources:\n- {id: a, url: 'https://x', in_force_from: 2020-01-01}\n")
    assert files.yaml_manifest(spark, str(tmp_path / "m.yaml")).first().download_strategy == "pdf"
    (tmp_path / "m.yaml").write_text("sources:\n- {id: a, other: 1}\n")
    with pytest.raises(ValueError, match="other"):
        files.yaml_manifest(spark, str(tmp_path / "m.yaml"))
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": \n')
    assert [r.line for r in files.bad_lines(spark, str(tmp_path / "j.json"), "a int").collect()] == ['{"a": ']
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(tmp_path / "j.json"), "a int").collect()
    assert files.update_candidate(spark.createDataFrame([("changed",), ("unchanged",)], "status string")) and not files.update_candidate(spark.createDataFrame([("changed",), ("check_failed",)], "status string"))


def test_summaries_of_every_type(spark):
    payloads = [
        {"type": "answer", "sections": [{"heading": "India", "claims": [{"status": "verified", "text": "c"}], "gaps": [{"text": "g"}]}], "dropped_claims": 2, "confidence": {"level": "high", "score": 0.9}},
        {"type": "refusal", "reason": "r", "message": "m"}, {"type": "result", "category_label": "C", "requirements": [{"text": "q"}]}, {"type": "patent_risk", "gauge": "low", "score": 0.1, "per_section": [{"section": "3(p)", "risk": "low", "reasons": ["why"]}]},
        {"type": "abs", "summary": "s", "checklist": [{"title": "t", "authority": "none", "detail": "d"}, {"title": "u", "authority": "x", "detail": "e", "required": False, "exempt": True}]}, {"type": "tk_radar", "normalized_ingredients": [{"input": "a", "canonical_latin": "b"}], "matches": [{"name": "n", "similarity": 0.5}]}, {"type": "other"},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(9, None)], "i int, p string")
    got = {r.i: r.x for r in df.select("i", history.summary_lines(F.col("p")).alias("x")).collect()}
    assert got[0] == ["India:", "  [verified] c", "  [gap] g", "2 statement(s) removed: could not be verified.", "Confidence: high (0.9)"] and got[1] == ["Reason: r", "m"]
    assert got[2] == ["Category: C", "  Requirement: q"] and got[3][1:] == ["  s.3(p): low", "    - why"] and got[4][1] == "  [unassessed] t (authority: none)" and got[4][3] == "  [exempt] u (authority: x)"
    assert got[5] == ["Normalised ingredients:", "  a -> b", "Closest classical matches:", "  n (similarity 0.5)"] and got[6] == ['{"type": "other"}'] and got[9] is None


def test_formulations_are_matched_with_their_sets(spark):
    asked = spark.createDataFrame([(1, ["a", "b"], "Skin"), (2, [], None)], "ask int, items array<string>, indication string")
    known = spark.createDataFrame([(10, ["b", "c"], ["skin care"]), (11, ["a", "b"], []), (12, ["z"], [])], "ref int, items array<string>, indications array<string>")
    got = [(r.ask, r.ref, r.score, r.overlap, r.missing, r.extra, r.indication_match) for r in am.formulation_matches(asked, known).orderBy("rank").collect()]
    assert got == [(1, 11, 1.0, ["a", "b"], [], [], False), (1, 10, 0.48, ["b"], ["c"], ["a"], True)]
    radar = am.tk_radar(asked, spark.createDataFrame([("A", "a"), ("b", "b")], "name string, canonical string"), known, spark.createDataFrame([("case", ["a"])], "case string, species array<string>")).orderBy("ask").collect()
    assert [r.canonical for r in radar] == [["a", "b"]] and radar[0].watchlist == ["case"] and [m.ref for m in radar[0].matches] == [11, 10]


def test_small_helpers(spark):
    got = many(
        spark, a=tx.section_order(F.lit("19A")), b=tx.section_order(F.lit("19")), c=tx.section_order(F.lit("")), d=tx.is_ancestor(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))), e=tx.is_ancestor(F.array(F.lit("x")), F.array(F.lit("x"))), f=tx.embed_text(F.array(F.lit("p"), F.lit("q")), F.lit("t")),
        g=quality.needs_ocr_review(F.lit("<< Previous | Next >>"), F.lit(" x"), F.lit(1.0)), h=quality.needs_ocr_review(F.lit(""), F.lit(" \n"), F.lit(1.0)), i=quality.page_density(F.lit("ab"), F.lit(0)), j=gate.default_day(F.lit(None).cast("date"), "2024-01-02").cast("string"))
    assert got == {"a": pytest.approx(19.1), "b": 19.0, "c": 0.0, "d": True, "e": False, "f": "p > q\nt", "g": False, "h": True, "i": 0.0, "j": "2024-01-02"}
    nested = spark.sql("select named_struct('b', map('c', 5)) as a union all select null")
    assert [r.x for r in nested.select(rules.condition({"field": "a.b.c", "op": "gte", "value": 5}).alias("x")).collect()] == [True, False]
    edges = spark.createDataFrame([("d", "a", "b", "proviso_of"), ("d", "a", "gone", "amends")], "doc string, src string, dst string, kind string")
    units = spark.createDataFrame([("d", "a", None), ("d", "b", "a"), ("d", "c-proviso", "zz")], "doc string, key string, parent string")
    sections, kept, dropped = graph.load_sections(units, edges)
    ids = {r.key: (r.section_id, r.parent_id) for r in sections.collect()}
    assert ids["b"][1] == ids["a"][0] and ids["c-proviso"][1] is None and kept.count() == 1 and [r.dst for r in dropped.collect()] == ["gone"]


def slow_increasing(values):
    best, before = [1] * len(values), [-1] * len(values)
    for i, v in enumerate(values):
        for j in range(i):
            if values[j] < v and best[j] + 1 > best[i]:
                best[i], before[i] = best[j] + 1, j
    at = max(range(len(values)), key=lambda i: (best[i], i), default=-1)
    out = []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def test_longest_increasing_equals_the_quadratic_one():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        values = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 25))]
        assert structure.longest_increasing(values) == slow_increasing(values)


def test_fuzzy_names_against_all_pairs(spark):
    import difflib
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 12)))
    names, entries = [word() for _ in range(40)] + ["", "ABC", None], sorted({word() for _ in range(40)} | {"abc", "AbC"})
    got = rules.fuzzy_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(e,) for e in entries], "entry string"), "name", "entry").collect()
    want = set()
    for n in {n for n in names if n is not None}:
        same = [(e, 1.0) for e in entries if e.lower() == n.lower()]
        if not same and n:
            near = [(e, difflib.SequenceMatcher(a=e.lower(), b=n.lower()).ratio()) for e in entries]
            same = sorted([x for x in near if x[1] >= 0.6], key=lambda x: (-x[1], x[0]))[:3]
        want |= {(n, e, round(r, 6)) for e, r in same}
    assert {(r.name, r.entry, round(r.ratio, 6)) for r in got} == want


def test_requests_meet_chunks_by_salts_too(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "live", "IN", "2020-01-01", None) for i in range(30)], "chunk_id int, version string, jurisdiction string, a string, b string").selectExpr("chunk_id", "version", "jurisdiction", "cast(a as date) valid_from", "cast(b as date) valid_to")
    requests = spark.createDataFrame([(1, "IN", "2021-01-01"), (2, "IN", "2019-01-01")], "query_id int, jurisdiction string, d string").selectExpr("query_id", "jurisdiction", "cast(d as date) as_of")
    want = sorted((r.query_id, r.chunk_id) for r in gate.gate_requests(requests, chunks).collect())
    monkeypatch.setattr(gate, "BROADCAST_ROWS", 0)
    assert sorted((r.query_id, r.chunk_id) for r in gate.gate_requests(requests, chunks).collect()) == want == [(1, i) for i in range(30)]
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id int, vec array<float>")
    asked = vectors.selectExpr("item_id as query_id", "vec as qvec")
    want = sorted((r.query_id, r.item_id, r.score) for r in ranking.dense(asked, vectors).collect())
    monkeypatch.setattr(ranking, "BLOCK", 2)
    assert sorted((r.query_id, r.item_id, r.score) for r in ranking.dense(asked, vectors).collect()) == want and len(want) == 25


def test_unknown_requests_are_dealt_by_their_number(spark, monkeypatch):
    """A task's rows, and with them its memory, don't grow with the tables; repeated requests take no row twice, null keys are unknown."""
    from attesta.operators import history

    monkeypatch.setattr(history, "TASK_ROWS", 10)
    rows = spark.createDataFrame([(i if i else None, i) for i in range(120)], "k int, n int")
    asked = spark.createDataFrame([(i,) for i in (*range(0, 120, 3), 3, 3, None)], "k int")
    known, rejected = history.unknown_requests(rows, asked, "k")
    assert sorted(r.n for r in known.collect()) == list(range(3, 120, 3)) and sorted(r.n for r in rejected.collect()) == sorted({*range(120)} - {*range(3, 120, 3)})
    assert {r.reason for r in rejected.collect()} == {"unknown_request"}
    for df in (known, rejected):
        assert "RepartitionByExpression [k#" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and ", 12" in plan and "Aggregate" not in plan


def test_number_words_are_matched_as_by_a_plain_list():
    """Patterns that look at the first letter match what a list of all words matches."""
    import random
    import re

    words = lambda *d: "|".join(sorted({k for x in d for k in x}, key=lambda w: (-len(w), w)))
    plain = rf"(?i)\b(?:{words(tx.ONES, tx.TENS, tx.MULTIPLIERS, tx.ORDINALS)})(?:[\s-](?:{words(tx.ONES, tx.TENS, tx.MULTIPLIERS)}))*\b"
    rnd, parts = random.Random(1), [*tx.ONES, *tx.TENS, *tx.ORDINALS, *tx.MULTIPLIERS, "x", "_", "12", "Teen"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "-", "\n", "", ". "]) for _ in range(rnd.randint(1, 8)))
        for t in (text, text.upper()):
            assert [m.span() for m in re.finditer(plain, t)] == [m.span() for m in re.finditer(tx.NUMBER_WORDS, t)]


def test_verdicts_are_made_once(spark):
    """What reads checked claims reads stored ones: no pattern is matched again."""
    from attesta.plans import claims

    for name in ("answer_cards", "verification_outcome", "cited_spans"):
        plan = claims.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "unsupported_number" not in plan and "regexp_extract_all" not in plan.lower()

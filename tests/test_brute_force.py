"""Queries that SQL can't express, against plain Python over the whole tables."""

import hashlib
import json
import os
import re
from collections import deque
from decimal import ROUND_HALF_UP, Decimal

import pytest

from attesta.functions import text as tx
from attesta.operators import structure
from attesta.plans import catalog, text as plans
from attesta.streaming.rate_limit import decide

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the data tables")
SPACE = r" \t\n\x0b\f\r"


def rx(pattern):
    """A pattern of the engine for Python: its classes are of ASCII."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE).replace(r"\w", "A-Za-z0-9_").replace(r"\d", "0-9"), pattern)
    return re.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\w", "[A-Za-z0-9_]").replace(r"\d", "[0-9]"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, table):
    return spark.read.parquet(f"{DATA}/{table}.parquet").collect()


def got(spark, name, *columns):
    found = [tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, DATA).collect()]
    assert found
    return sorted(found, key=str)


def same(found, want):
    assert found == sorted(want, key=str)


SECTION, YEAR, DIGITS, HEDGE = map(rx, (tx.SECTION, tx.YEAR, tx.DIGITS, tx.HEDGE))
ALL_WORDS, GO_ON = [sorted(w, key=lambda x: (-len(x), x)) for w in ({**tx.ONES, **tx.TENS, **tx.MULTIPLIERS, **tx.ORDINALS}, {**tx.ONES, **tx.TENS, **tx.MULTIPLIERS})]
PHRASE = rx(rf"(?i)\b(?:{'|'.join(ALL_WORDS)})(?:[\s-](?:{'|'.join(GO_ON)}))*\b")


def numbers(text):
    text = SECTION.sub(" ", text)
    found = {re.sub(f"[,{SPACE}]", "", m[0]) for m in DIGITS.finditer(text)} | {m[1] for m in rx(r"(?i)\b(\d+)(?:st|nd|rd|th)\b").finditer(text)}
    for phrase in PHRASE.finditer(text):
        n = 0
        for w in re.split(f"[{SPACE}-]+", phrase[0].lower()):
            n = (n or 1) * tx.MULTIPLIERS[w] if w in tx.MULTIPLIERS else n + {**tx.ONES, **tx.TENS, **tx.ORDINALS}[w]
        if n < 2**63:
            found.add(str(n))
    return found


def refs(text):
    return {"section " + m[1].lower() for m in SECTION.finditer(text)}


def verdict(entailment, claim, premise, titles="", located=()):
    known = f"{premise} {titles}" if titles is not None else premise
    says = lambda t, w: bool(rx(rf"(?i)\b{w}\b").search(t))
    if entailment < 0.5:
        return "nli_below_threshold"
    if numbers(claim) - numbers(known):
        return "unsupported_number"
    if set(YEAR.findall(claim)) - set(YEAR.findall(known)):
        return "unsupported_date"
    if refs(claim) - refs(premise) - set(located):
        return "unsupported_section_reference"
    hedged = HEDGE.search(premise) and not HEDGE.search(claim) and (says(claim, "shall") or says(claim, "may"))
    modal = says(claim, "shall") and says(premise, "may") and not says(premise, "shall") or says(claim, "may") and says(premise, "shall") and not says(premise, "may")
    return "verified" if entailment >= 0.8 and not hedged and not modal else "partial"


def test_guards_and_verdicts(spark):
    mixed = plans.mixed(spark, DATA).collect()
    same(got(spark, "guard_numbers", "doc_id", "ok"), [(r.doc_id, not numbers(r.whole) - numbers(r.premise)) for r in mixed])
    verdicts = [(r.doc_id, verdict(r.entailment, r.whole, r.premise, None)) for r in mixed]
    same(got(spark, "claim_verdict", "doc_id", "verdict"), verdicts)
    bad = [v for _, v in verdicts if v not in ("verified", "partial")]
    same(got(spark, "drop_reasons", "verdict", "n"), [(v, bad.count(v)) for v in set(bad)])


@pytest.fixture(scope="module")
def checked(spark):
    """Packs by document, and (claim, cited spans, verdict) of each claim that stays."""
    packs, claims = {}, {}
    for d in rows(spark, "documents"):
        if d.text is None:
            continue
        pack = packs[d.doc_id] = []
        for line, text in enumerate(d.text.split("\n")):
            path = [f"S{line // 4}"] + ([f"C{line % 4}"] if line % 4 else [])
            key = f"d{d.doc_id}#s{line // 4}" + (f"({line % 4})" if line % 4 else "")
            place = "INTL" if line % 7 == 6 or d.lang != "en" else "IN"
            pack.append({"n": line + 1, "id": "ev_" + sha(f"d{d.doc_id}#s{line}:0:{len(text)}")[:12], "place": place, "key": key, "path": path, "text": text})
        for s in pack:
            n = s["n"]
            if n % 5 == 0 or n == len(pack) or pack[n]["place"] != s["place"]:
                continue
            cited = []
            for own in (s, pack[n]):
                parent = pack[(own["n"] - 1) // 4 * 4]
                for c in ([parent] if parent is not own and parent["place"] == own["place"] else []) + [own]:
                    if c not in cited:
                        cited.append(c)
            statement = "Under the Act 1970 section " + s["key"].split("#s")[1] + (" within 30 days" if n % 3 == 0 else "")
            premise = "\n\n".join(" > ".join(c["path"]) + "\n" + c["text"] for c in cited)
            located = {"section " + part for c in cited for k in [c["key"].split("#s")[1]] for part in (k, k.split("(")[0])}
            claims.setdefault(d.doc_id, []).append((n, statement, cited, verdict(n * 37 % 101 / 100.0, statement, premise, "Act 1970", located), n * 37 % 101 / 100.0))
    return packs, claims


def kept(claims):
    return [c for c in claims if c[3] in ("verified", "partial")]


def test_claims_and_outcomes(spark, checked):
    packs, claims = checked
    same(got(spark, "claim_check", "query_id", "claim_no", "verdict"), [(q, n, v) for q, cs in claims.items() for n, _, _, v, _ in cs])
    want = []
    for q, cs in claims.items():
        good = kept(cs)
        reasons = [c[3] for c in cs if c not in good]
        mean = sum(Decimal(str(c[4])) for c in good) / len(good) if good else 0
        want.append((q, len(good), len(reasons), round(float(mean), 6), ",".join(f"{r}={reasons.count(r)}" for r in sorted(set(reasons))), round(sum(c[3] == "verified" for c in cs) / len(cs), 6), any(c[3] == "partial" for c in cs)))
    found = got(spark, "verification_outcome", "query_id", "kept", "dropped", "mean_entailment", "drop_reasons", "verified_ratio", "review")
    assert [(*r[:3], pytest.approx(r[3], abs=2e-6), r[4], pytest.approx(r[5], abs=2e-6), r[6]) for r in found] == sorted(want, key=str)
    spans = {(q, s["n"], s["id"]) for q, cs in claims.items() for c in kept(cs) for s in c[2]} | {(q, s["n"], s["id"]) for q, p in packs.items() for s in p[:3]}
    same(got(spark, "cited_spans", "query_id", "number", "evidence_id"), spans)


def test_answers(spark, checked):
    packs, claims = checked
    sections, cards = [], []
    terms = [("section", {"fr": "article", "de": "Paragraph", "es": "artículo"}), ("30 days", {"fr": "30 jours", "de": "30 Tage"}), ("proviso", {"fr": "réserve"})]
    for d in rows(spark, "documents"):
        good, by = kept(claims.get(d.doc_id, [])), {}
        for _, statement, cited, _, _ in good:
            by.setdefault(cited[0]["place"], []).append(statement)
        for i, place in enumerate(["IN", "INTL"]):
            sections.append((d.doc_id, place, i, len(by.get(place, [])), sha("\n".join(by.get(place, []))), int(i == 0)))
        asked = "IN" if d.lang == "en" else "INTL"
        order = [asked, *(p for p in by if p != asked)]
        said = " ".join(c[1] for c in good).lower()
        spans = sorted({s["id"]: f"{s['id']}={s['n']} {s['key']}" for c in good for s in c[2]}.items())
        gloss = [f"{t}={g[d.lang]}" for t, g in terms if d.lang != "en" and d.lang in g and t in said]
        cards.append((d.doc_id, "|".join(f"{p}:{';'.join(by.get(p, []))}:{int(p == asked)}" for p in order), ",".join(v for _, v in spans), ",".join(gloss)))
    same(got(spark, "answer_assembly", "query_id", "jurisdiction", "position", "n_claims", "claims_sha256", "n_gaps"), sections)
    same(got(spark, "answer_cards", "query_id", "sections", "evidence", "glossary"), cards)
    assert any(c[3] for c in cards) and any(c[2] for c in cards)


def test_receipts(spark):
    docs = {d.doc_id: d for d in rows(spark, "documents")}
    logs, want = {}, []
    for c in rows(spark, "conversations"):
        if c.role == "user":
            logs.setdefault(c.conv_id, []).append(c)
    canonical = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))
    for log, turns in logs.items():
        last, d = "0" * 64, docs.get(log)
        for c in sorted(turns, key=lambda c: c.turn):
            spans = [{"chunk_id": d.doc_id, "evidence_id": f"ev_d{d.doc_id}", "sha256": sha(d.text)}] if d else []
            result = sha(canonical({"message": c.text, "receipt_id": ""}))
            entry = canonical({
                "chunk_hashes": [s["sha256"] for s in spans], "corpus_version": ("staged" if d.doc_id % 10 == 9 else "live") if d else "none", "model_ids": {"llm": "none", "embed": "none"}, "prompt_version": "v1", "query_hash": sha(c.text),
                "request_id": f"{log}-{c.turn}", "request_payload_hash": None, "result_hash": result, "result_receipt_field": "", "spans": spans, "ts": "2024-01-01T00:00:00Z"})
            now = sha(last + entry)
            want.append((log, c.turn, f"rcp_{c.turn}", result, last, now))
            last = now
    same(got(spark, "receipt_chain", "log", "seq", "receipt_id", "result_hash", "prev_hash", "entry_hash"), want)


def test_review_roots(spark):
    from datetime import date, timedelta

    types = "statute rule regulation notification treaty guideline form order".split()
    leaves = {}
    for d in rows(spark, "documents"):
        start = date(2020, 1, 1) + timedelta(d.doc_id % 1461)
        where = {"doc_type": types[d.doc_id % 8], "jurisdiction": "IN" if d.lang == "en" else "INTL", "valid_from": str(start), "valid_to": str(start + timedelta(365)) if d.doc_id % 3 == 0 else None}
        for line, text in enumerate(d.text.split("\n")):
            named = json.dumps(where | {"line": line}, sort_keys=True, separators=(",", ":"))
            leaves.setdefault("staged" if d.doc_id % 10 == 9 else "live", []).append((f"d{d.doc_id}#s{line}", sha(f"d{d.doc_id}#s{line}|{sha(text)}|{sha(named)}")))
    want = []
    for version, own in leaves.items():
        level = [leaf for _, leaf in sorted(own)]
        while len(level) > 1:
            level = [hashlib.sha256(bytes.fromhex(level[i] + level[i + 1])).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        want.append((version, level[0]))
    same(got(spark, "review_roots", "version", "root"), want)


def test_limits_and_rising_rows(spark):
    users = {}
    for e in rows(spark, "events"):
        users.setdefault(e.user_id, []).append(e)
    limits, rising = [], []
    for user, own in users.items():
        own.sort(key=lambda e: (e.ts, e.event_id))
        times = [e.ts.timestamp() for e in own]
        limits += [(user, e.event_id, a, round(w, 4)) for e, (a, w) in zip(own, decide(times, deque(), 3, 6 * 3600.0), strict=True)]
        own.sort(key=lambda e: e.event_id)
        numbers_ = [e.event_id * 37 % 101 % 12 + 1 for e in own]
        rising += [(user, own[i].event_id, numbers_[i]) for i in structure.longest_increasing(numbers_)]
    found = [(u, e, a, round(w, 4)) for u, e, a, w in got(spark, "rate_limit", "user_id", "event_id", "allowed", "retry_after")]
    same(sorted(found, key=str), limits)
    same(got(spark, "lis_rules", "doc", "place", "number"), rising)


def segments(text, limit=1800):
    def packed(items):
        out, now = [], ""
        for x in items:
            if len(x) > limit:
                out += ([now] if now else []) + [x[i : i + limit] for i in range(0, len(x), limit)]
                now = ""
            elif len(now) + 1 + len(x) <= limit or not now:
                now = f"{now} {x}" if now else x
            else:
                out, now = [*out, now], x
        return out + ([now] if now else [])

    if len(text) <= limit:
        return [text]
    return packed([p for s in re.split(f"(?<=[.!?])[{SPACE}]+|\n+", text) for p in packed(s.split())])


def test_segments(spark):
    want = [(d.doc_id, i, len(s), sha(s)) for d in rows(spark, "documents") for i, s in enumerate(segments(d.text))]
    same(got(spark, "text_segments", "doc_id", "segment", "size", "sha256"), want)


def valid(digits):
    """The check digit by the dihedral group of ten, as rotations and reflections (s, r)."""
    perm = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    s, r = 0, 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        for _ in range(i % 8):
            x = perm[x]
        s, r = s ^ (x >= 5), (r + x % 5) % 5 if not s else (r - x % 5) % 5
    return s == 0 and r == 0


def scrubbed(text):
    kinds = []
    for m in dict.fromkeys(rx(tx.AADHAAR).findall(text)):
        if valid(re.sub(f"[{SPACE}]", "", m)):
            text, kinds = text.replace(m, "[AADHAAR]"), ["AADHAAR"]
    for kind, pattern in tx.PII:
        text, n = rx(pattern).subn(f"[{kind}]", text)
        kinds += [kind] * n
    return text, kinds


def test_personal_data_and_its_kinds(spark):
    same(got(spark, "pii_kinds", "doc_id", "kinds"), [(r.doc_id, ",".join(scrubbed(r.claim)[1])) for r in plans.mixed(spark, DATA).collect()])
    number = next(str(n) for n in range(234567890120, 234567890130) if valid(str(n)))
    texts = [f"{number} and {number}, 22ABCDE1234F1Z5 ABCDE1234F a@b.co 9876543210 a@b.co", "nothing", "", None, "123412341234 9876543210"]
    kinds = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.pii_kinds(tx.F.col("t")).alias("k"))
    assert [r.k or [] for r in kinds.collect()] == [scrubbed(t or "")[1] for t in texts]
    want = []
    for d in rows(spark, "documents"):
        text = scrubbed("mail a.b@c.org " + d.text)[0]
        p = {"claims": [{"text": text}], "extra": {"note": "call [PHONE]", "evidence": "call 9876543210"}, "evidence": [d.text]}
        want.append((d.doc_id, sha(json.dumps(p, ensure_ascii=False, separators=(",", ":"))), text[:12], "call [PHONE]", "call 9876543210"))
    same(got(spark, "scrubbed_payloads", "doc_id", "sha256", "head", "note", "evidence_note"), want)


def test_radar(spark):
    part = {p.p_partkey: p for p in rows(spark, "part")}
    brands = {p.p_brand for p in part.values()}
    known, cases, orders = {}, {}, {}
    for p in part.values():
        known.setdefault(p.p_partkey % 200, (set(), set()))
        known[p.p_partkey % 200][0].add(p.p_brand)
        known[p.p_partkey % 200][1].add(p.p_type.lower())
        cases.setdefault(p.p_type, set()).add(p.p_brand)
    for line in rows(spark, "lineitem"):
        if line.l_orderkey % 50 == 0 and line.l_partkey in part:
            o = orders.setdefault(line.l_orderkey, (set(), set()))
            o[0].add(part[line.l_partkey].p_brand)
            o[1].add(part[line.l_partkey].p_type.split(" ")[0])
    want = []
    for ask, (items, kinds) in orders.items():
        names = ["unknown herb" if b == "Brand#11" else b for b in sorted(items)]
        canonical = [n for n in names if n in brands]
        scores = []
        for ref, (own, uses) in known.items():
            both = len(own & set(canonical))
            if both:
                exact = min(1.0, both / len(own | set(canonical)) + (0.15 if any(min(kinds).lower() in u for u in uses) else 0.0))
                scores.append((-float(Decimal(repr(exact)).quantize(Decimal("0.01"), ROUND_HALF_UP)), ref))
        watch = sorted(c for c, species in cases.items() if species & set(canonical))
        want.append((ask, ",".join(canonical), ",".join(names), ",".join(f"{r}={-s}" for s, r in sorted(scores)[:8]), ",".join(watch)))
    same(got(spark, "tk_radar", "ask", "canonical", "terms", "matches", "watchlist"), want)


def test_routes_with_the_turn_before(spark):
    from attesta.functions import routing

    turns = {}
    for c in rows(spark, "conversations"):
        turns.setdefault(c.conv_id, []).append(c)
    pairs = []
    for own in turns.values():
        own.sort(key=lambda c: c.turn)
        pairs += [(c.conv_id, c.turn, c.text, own[i - 1].text if i else "") for i, c in enumerate(own) if c.role == "user"]
    routed = spark.createDataFrame([(*p, f"{p[2]}\nPrior topic: {p[3]}") for p in pairs], "conv_id bigint, turn bigint, text string, before string, both string")
    t, plain = tx.F.col("text"), []
    for r in routed.select("*", routing.route(t).alias("first"), routing.route(tx.F.col("both")).alias("again"), t.rlike(routing.UNRELATED).alias("off")).collect():
        taken = r.again if r.first.intent == "out_of_scope" and r.before and not r.off else r.first
        plain.append((r.conv_id, r.turn, taken.intent, taken.section_key))
    same(got(spark, "context_routes", "conv_id", "turn", "intent", "section_key"), plain)

"""Stems, cover density and trigram search against brute force and published examples."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.functions.stem import stemmed
from attesta.operators import ranking

#: Examples published with the algorithm.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil inventions invent patentability patent infringement infring""".split()


def plain_porter(w):
    """The same rules letter by letter."""
    if not re.fullmatch("[a-z]{3,64}", w):
        return w
    vowel = lambda s, i: s[i] in "aeiou" or s[i] == "y" and i > 0 and not vowel(s, i - 1)
    measure = lambda s: sum(vowel(s, i - 1) and not vowel(s, i) for i in range(1, len(s)))
    some = lambda s: any(vowel(s, i) for i in range(len(s)))
    cvc = lambda s: len(s) > 2 and not vowel(s, len(s) - 1) and vowel(s, len(s) - 2) and not vowel(s, len(s) - 3) and s[-1] not in "wxy"

    def longest(w, rules):
        for suffix, by, fits in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                stem = w[:len(w) - len(suffix)]
                return stem + by if fits(stem) else w
        return w

    w = longest(w, [(a, b, lambda s: True) for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))])
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                s = w[:-len(suffix)]
                if some(s):
                    if s.endswith(("at", "bl", "iz")):
                        w = s + "e"
                    elif len(s) > 1 and s[-1] == s[-2] and not vowel(s, len(s) - 1) and s[-1] not in "lsz":
                        w = s[:-1]
                    else:
                        w = s + "e" if measure(s) == 1 and cvc(s) else s
                break
    if w.endswith("y") and some(w[:-1]):
        w = w[:-1] + "i"
    pairs = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
    w = longest(w, [(a, b, lambda s: measure(s) > 0) for a, b in zip(pairs[::2], pairs[1::2])])
    w = longest(w, [(a, b, lambda s: measure(s) > 0) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))])
    ends = [(a, "", lambda s: measure(s) > 1) for a in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()]
    w = longest(w, [*ends, ("ion", "", lambda s: measure(s) > 1 and s[-1:] in ("s", "t"))])
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stems_of(spark, words):
    return {r.w: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}


def test_published_stems(spark):
    want = dict(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert stems_of(spark, want) == want


def test_stems_of_random_words(spark):
    rnd = random.Random(1)
    ends = "ational tional enci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion tion sion ou ism ate iti ous ive ize ed ing eed y e s ll ies sses".split()
    words = {"".join(rnd.choice("aeiouybcdlnrstwxz") for _ in range(rnd.randint(1, 6))) + "".join(rnd.choice(ends) for _ in range(rnd.randint(0, 3))) for _ in range(3000)} | {"yyyy", "syzygy", "a", "is", "ß", "x1ing", "été", "running" * 10}
    assert stems_of(spark, words) == {w: plain_porter(w) for w in words}
    assert stemmed(spark.createDataFrame([(None, 1)], "w string, stem2 int"), "w").collect()[0].stem is None


def tokens(t):
    return re.findall(r"\w+", (t or "").lower())


def brute_covers(question, text):
    q, w = list(dict.fromkeys(tokens(question))), tokens(text)
    at = [i for i, x in enumerate(w) if x in q]
    exact = set(q) <= set(w)
    holds = [(i, j) for i in at for j in at if i <= j and set(q) <= set(w[i:j + 1])] if exact else []
    covers = [c for c in holds if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in holds)]
    weight = sum(0.1 / (1 + sum(x not in q for x in w[i:j + 1])) for i, j in covers)
    return exact, len(covers), round(weight / (1 + math.log(len(w))), 9), round(0.1 * len(at) / len(w), 9)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_covers_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    rnd = random.Random(2)
    words = ["claim", "patent", "plant", "use", "of", "the", "act"]
    questions = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))) for i in range(8)] + [(90, "claim claim"), (91, "!?"), (92, None), (93, "absent word")]
    texts = [(f"c{i}", " ".join(rnd.choice([*words, "x", "y", "z"]) for _ in range(rnd.randint(1, 30)))) for i in range(200)] + [("e", ""), ("n", None), ("r", "claim " * 25), ("s", "claim " * 25)]
    asked, chunks = spark.createDataFrame(questions, "query_id int, question string"), spark.createDataFrame(texts, "chunk_id string, text string").withColumn("i", F.lit(1)).withColumn("term", F.lit("x"))
    got = {(r.query_id, r.chunk_id): (r.exact, r.covers, r.cover, r.density) for r in ranking.cover_density(asked, chunks).collect()}
    want = {(q, c): brute_covers(a, t) for q, a in questions for c, t in texts if set(tokens(a)) & set(tokens(t))}
    assert got.keys() == want.keys() and any(x[1] > 2 for x in want.values())
    for k in want:
        assert got[k][:2] == want[k][:2] and got[k][2:] == pytest.approx(want[k][2:], abs=2e-9)
    plain = {(r.query_id, r.chunk_id): (r.exact, r.density) for r in ranking.full_text(asked, chunks).collect()}
    assert plain == {k: (v[0], v[3]) for k, v in got.items()}
    best = ranking.top_k(ranking.cover_density(asked, chunks), ["query_id"], [F.desc("exact"), F.desc("cover"), F.desc("density"), "chunk_id"], 300).collect()
    for q in {r.query_id for r in best}:
        rows = sorted((r for r in best if r.query_id == q), key=lambda r: r["rank"])
        assert rows == sorted(rows, key=lambda r: (not r.exact, -r.cover, -r.density, r.chunk_id))
    none = spark.createDataFrame([], "query_id int, question string")
    assert ranking.cover_density(none, chunks).collect() == []


def test_stemmed_search_equals_brute_force(spark):
    texts = [("a", "Patents claimed by inventors"), ("b", "the inventor's patent claims; claiming"), ("c", "plants"), ("d", None), ("e", "patents patents patenting")]
    questions = [(1, "patent claim"), (2, "inventing plants"), (3, None), (4, "patented patents")]
    got = {(r.query_id, r.chunk_id): r.score for r in ranking.stemmed_bm25(spark.createDataFrame(questions, "query_id int, question string"), spark.createDataFrame(texts, "chunk_id string, text string")).collect()}
    held = {c: [plain_porter(w) for w in tokens(t)] for c, t in texts if t is not None}
    n, mean, want = len(texts), sum(map(len, held.values())) / len(held), {}
    for q, a in questions:
        for c, w in held.items():
            parts = []
            for term in {plain_porter(x) for x in tokens(a)}:
                df, tf = sum(term in x for x in held.values()), w.count(term)
                if tf:
                    parts.append(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)))
            if parts:
                want[q, c] = round(sum(parts), 6)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def grams(t):
    return {f"  {w} "[i:i + 3] for w in re.findall("[a-z0-9]+", (t or "").lower()) for i in range(len(w) + 1)}


@pytest.mark.parametrize(("limit", "k"), [(200_000, 10), (0, 3)])
def test_trigram_search_equals_all_pairs(spark, monkeypatch, limit, k):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    phrase = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    sections = [(f"s{i}", f"act{i % 20} s{i}", phrase(rnd.randint(1, 12))) for i in range(250)] + [("t1", "k", None), ("t2", "", ""), ("t3", "3(p)", "What are not inventions"), ("t4", "3(p)", "What are not inventions"), ("t5", None, "same same")]
    questions = [(i, sections[i * 7][2] + " " + phrase(2)) for i in range(12)] + [(50, "3(p)"), (51, "zzz qqq"), (52, ""), (53, None), (54, "what are inventions")]
    counted = {}
    got = sorted((r.query_id, r.section_id, r.sim, r["rank"]) for r in ranking.trigram_search(spark.createDataFrame(questions, "query_id int, question string"), spark.createDataFrame(sections, "section_id string, key string, heading string"), k=k, counted=counted).collect())
    want = []
    for q, t in questions:
        g, sims = grams(t), []
        for s, key, heading in sections:
            sim = max((len(g & x) / len(g | x) if g | x else 0) for x in (grams(key), grams(heading)))
            if round(sim, 6) > 0.2:
                sims.append((-round(sim, 6), s))
        want += [(q, s, -x, n) for n, (x, s) in enumerate(sorted(sims)[:k], 1)]
    assert got == sorted(want)
    assert counted["pairs"] < len(sections) * len(questions) / 10


def test_a_hot_term_is_dealt_to_salts(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)
    rows = spark.range(2000).selectExpr("'hot' AS term", "id")
    out = ranking.meet(rows, spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "term string, q int"), ["term"], "id")
    assert out.columns == ["term", "id", "q"]
    assert Counter(r.q for r in out.collect()) == {1: 2000, 2: 2000}

"""Decontamination, near-duplicates and repeated passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import decontaminate, graph, minhash, suffix

SCHEMA = "doc_id bigint, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def item_windows(items, size=10):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = item_words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add(str(k))
    return windows


def brute_windows(docs, items, size=10):
    words, windows = item_words, item_windows(items, size)
    lengths = {len(x) for x in windows}
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rnd = random.Random(2)
    vocabulary = ["the", "of", "Ünd", "x1", *(f"w{i}" for i in range(30))]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([4, 10, 15, 30]))) for i in range(20)] + [(20, None), (21, ""), (22, "..."), (23, "the of"), (24, "the of")]
    items += [(30, items[3][1])]
    docs = [(i, text(40) + ". " + rnd.choice(items)[1].upper().replace(" ", ", ") if i % 3 == 0 and (items[i % 20][1]) else text(50)) for i in range(40) if items[i % 20][1]]
    docs = [(k, t) for k, t in docs if t] + [(None, items[0][1]), (50, None), (51, ""), (52, "THE OF"), (52, "the"), (53, items[5][1] * 300), (54, " ".join([items[2][1]] * 2)), (54, " ".join([items[2][1]] * 2))]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination_report(df, bench).collect()), key=str)
    assert got == brute_windows(docs, items)
    kept = decontaminate.drop_contaminated(df.withColumn("start", df.doc_id), bench)
    assert kept.columns == ["doc_id", "text", "start"]
    assert kept.count() == sum(not r[-1] for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contamination_report(empty, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination_report(df, spark.createDataFrame([], "item_id bigint, text string")).collect())


def test_decontamination_by_shuffles_and_with_a_hot_term(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(i, "hot " * 3 + " ".join(rnd.choice(["hot", "a", "b", "c", "d"]) for _ in range(12))) for i in range(6)]
    docs = [(i, "hot " * rnd.randint(0, 60) + (items[i % 6][1] if i % 4 == 0 else "a b hot c")) for i in range(60)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_windows(docs, items)
    clash = df.selectExpr("*", "1 as doc", "2 as term", "3 as w", "4 as position")
    for rows in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        assert sorted((tuple(r) for r in decontaminate.contamination_report(clash, bench).collect()), key=str) == want
    monkeypatch.undo()
    parts = [i for i in range(128) if not chr(i).isalnum()]
    odd = spark.createDataFrame([(0, "".join(f"A{chr(i)}é" for i in parts))], SCHEMA)
    assert odd.select(decontaminate.words_of(odd.text).alias("w")).first().w == ["a", *["éa"] * (len(parts) - 1), "é"]


def test_proximity_allows_for_words_between(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string")
    docs = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha beta so gamma delta epsilon zeta eta theta iota kappa"), (3, "kappa iota theta eta"), (4, "alpha " + "x " * 30 + "beta gamma")]
    got = decontaminate.proximity_matches(spark.createDataFrame(docs, SCHEMA), bench)
    names = {hashlib.sha256(t.encode()).digest(): k for k, t in docs}
    assert {names[bytes(r.doc)] for r in got.collect()} == {1, 2}


def brute_proximity(docs, items, slop=3, k=3):
    counts = collections.Counter(w for _, t in docs for w in item_words(t))
    out = []
    for key, text in docs:
        w = item_words(text)
        starts, near = set(), set()
        for window, names in item_windows(items).items():
            if all(counts[x] for x in window):
                first, *rest = sorted(sorted(range(len(window)), key=lambda i: (counts[window[i]], i))[:k])
                for p in (i for i, x in enumerate(w) if x == window[first]):
                    if all(any(w[q] == window[r] and abs(q - r - (p - first)) <= slop for q in range(p + 1, len(w))) for r in rest):
                        starts.add(p - first)
                        near |= names
        out.append((key, len(starts), len(near), hashlib.sha256(",".join(sorted(near)).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_proximity_report_against_brute_force(spark):
    rnd = random.Random(8)
    some = lambda n: [f"t{min(int(rnd.expovariate(0.08)), 60)}" for _ in range(n)]
    passages = [some(n) for n in (14, 11, 10, 6, 2, 1)]
    docs = []
    for i in range(60):
        w = some(rnd.randrange(0, 40))
        if i % 2:
            part = list(rnd.choice(passages))
            for _ in range(rnd.randrange(3)):
                part.insert(rnd.randrange(len(part) + 1), "between")
            w[5:5] = part
        docs.append((i, " ".join(w)))
    docs += [(7, docs[7][1]), (200, docs[9][1]), (201, None), (202, ""), (None, docs[11][1])]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(50, None), (51, " ,"), (52, "absent " + " ".join(passages[0][:9])), (53, " ".join(passages[3]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc", decontaminate.F.lit(1))
    got = decontaminate.proximity_report(spark.createDataFrame(docs, SCHEMA).withColumn("doc", decontaminate.F.lit("x")), bench)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == brute_proximity(docs, items) and sum(r[1] > 0 for r in rows) > 20
    assert decontaminate.proximity_report(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert decontaminate.proximity_report(spark.createDataFrame(docs, SCHEMA), bench.where("false")).agg({"n_near": "max"}).first()[0] == 0


def brute_near(rows):
    sets, root = {}, {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


@pytest.mark.parametrize("block", [1024, 32])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "Solo"), (904, "solo"), (905, "a b c d"), (906, "A b\tc  d"), (907, "a b c d e"), (908, "x\x1cy é É"), (909, "x\x1cy é é")]
    for i in range(150):
        w = list(base) if i % 3 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 80))]
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3]) if i % 3 else 0):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i * 7 % 503, " ".join(w)))
    rows.append((950, " ".join(vocabulary * 40)))
    rows.append((951, " ".join(vocabulary * 40)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_edges(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(5, same, 1), (5, same, 2), (7, same, 3), (None, same, 4), (None, None, 5), (8, "other", 6)], "doc_id bigint, text string, kept int")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["kept"] for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_circulant_signatures_estimate_jaccard():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rnd.integers(0, 2**63, 200).astype(np.uint64)])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08


def brute_repeats(rows):
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if k is not None else 0):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], k), k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if k is not None else 0):
            if first[b[p:p + 50]] < k:
                gone[p:p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "part"), [(2 << 20, suffix.PART_BYTES), (2000, 500)])
def test_repeats(spark, monkeypatch, block, part):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé\0") for _ in range(4)) for _ in range(30)]
    passages = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(6)]
    rows = [(None, passages[0]), (None, None), (3, None), (4, ""), (5, "a" * 500), (5, "b" * 49), (6, "a" * 60 + "c"), (7, "a" * 49), (5, passages[1]), (5, passages[1] + "x"), (60, passages[0] * 20), (61, passages[0] * 20)]
    for _ in range(50):
        rows.append((rnd.randint(0, 50), " ".join([rnd.choice(passages)[rnd.randint(0, 60):][: rnd.randint(30, 120)] for _ in range(rnd.randint(0, 3))] + [rnd.choice(words)])))
    got = sorted((tuple(r) for r in suffix.repeat_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute_repeats(rows)


def test_repeats_keep_columns(spark):
    long = "é" * 40 + "same text that is shared by both of the two documents here" + "x"
    df = spark.createDataFrame([(1, "en", long, 9), (2, "fr", "y" + long[1:], 9), (3, "fr", None, 9)], "doc_id bigint, lang string, text string, n_chars bigint")
    got = {r.doc_id: r for r in suffix.drop_repeats(df).collect()}
    assert got[1].text == long and got[1].n_chars == len(long) and got[2].text == "y" and got[3].text == "" and got[2].lang == "fr"
    assert suffix.repeat_report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("part", [suffix.PART_BYTES, 2000, 300])
def test_parts_merge_by_binary_search(part):
    rnd = random.Random(3)
    base = [bytes(rnd.choice(b"ab\0") for _ in range(70)) for _ in range(5)]
    runs, docs, first = [], [], {}
    for _ in range(300):
        x, a = rnd.choice(base), rnd.randint(0, 20)
        runs.append(x[a:a + 50 + rnd.randint(0, 20 - a)])
        docs.append(rnd.randint(0, 40))
    for r, k in zip(runs, docs, strict=True):
        for p in range(len(r) - 49):
            first[r[p:p + 50]] = min(first.get(r[p:p + 50], 99), k)
    want = [first[r[p:p + 50]] < k for r, k in zip(runs, docs, strict=True) for p in range(len(r) - 49)]
    got = suffix.repeated_starts(np.frombuffer(b"".join(runs), np.uint8), np.array([len(r) for r in runs]), np.array(docs), part)
    assert got.tolist() == want


def test_suffix_array_sorts():
    t = np.frombuffer(b"banana\0bandana\0banana", np.uint8)
    sa = suffix.suffix_array(t, np.arange(len(t), 0, -1))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


def test_strays_of_a_large_bucket_send_few_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = [(7, i, 1, 100) for i in range(1000)] + [(7, 2000 + i, 2 + i, 100) for i in range(3)] + [(8, i, i, 5) for i in range(10)]
    members = spark.createDataFrame(rows, "bucket bigint, id bigint, comp bigint, n bigint")
    dealt = minhash._dealt(members, "bucket", 16).cache()
    assert dealt.where("bucket = 7").count() == 1000 + 3 * (63 + 1) and dealt.where("bucket = 8").count() == 10
    met = {(min(a.id, b.id), max(a.id, b.id)) for g in [dealt.where("bucket = 7").collect()] for a in g if a.side != 1 and a.comp != 1 for b in g if (b.kind, b.i, b.j) == (a.kind, a.i, a.j) and b.comp != a.comp and (b.side == 2 or b.side != a.side)}
    assert met == {(min(x, y), max(x, y)) for x in (2000, 2001, 2002) for y in [*range(1000), 2000, 2001, 2002] if x != y}
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    assert minhash._dealt(members, "bucket").where("bucket = 7 AND kind = 'inner'").select("j").distinct().count() == 250


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_plain_sums_share_no_shingle(spark):
    docs = [(2 * i, thue_morse(n, "ab")) for i, n in enumerate((1024, 2048, 4096))] + [(2 * i + 1, thue_morse(n, "ba")) for i, n in enumerate((1024, 2048, 4096))]
    docs += [(10, f"one two three four {thue_morse(2048, 'xy')}"), (11, f"one two three four {thue_morse(2048, 'yx')}"), (12, f"one two three four {thue_morse(2048, 'xy')}")]
    for secret in (None, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), secret=secret).collect()}
        assert got == brute_near(docs) and {k: c for k, (_, c, _) in got.items()} == {k: 10 if k == 12 else k for k, _ in docs}


def test_steps_of_few_words():
    for n in range(8):
        flat, offsets = minhash.shingle_sets(pa.array([" ".join("abcdefgh"[:n])]), 3)
        assert offsets.tolist() == [0, len(flat)] and len(flat) == (max(1, n - 4) if n else 0)


def test_runs_of_equal_hash_and_unlike_bytes_are_not_repeats(spark, monkeypatch):
    one = "mmmmmmmmmmmmmmmmwwwhstztvbjyhnppqxfyzoppoushhkwwhecdyouoruzammmmmmmmmmmmmmmm"
    two = "kjklmlkklmpnlmomwwwhstztvbjyhnppqxfyzoppoushhkwwhecdyouoruzamnknlllnnnlnnmmm"
    docs = [(1, one), (2, two), (3, one), (4, two), (5, two + one), (6, one), (7, two)]
    for block in (suffix.BLOCK_BYTES, 60):  # all in a block, and each in its own
        monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
        for rows in (docs[:2], docs):
            got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.repeat_report(spark.createDataFrame(rows, SCHEMA)).collect()}
            want = {k: (len(t), len(t) - n) for k, t, n in brute_cut(rows)}
            assert got == want and got[2] == (76, 0)


def brute_cut(docs):
    first = {}
    for k, t in docs:
        for p in range(len(t) - 49):
            first[t[p:p + 50]] = min(first.get(t[p:p + 50], k), k)
    for k, t in docs:
        gone = {q for p in range(len(t) - 49) if first[t[p:p + 50]] < k for q in range(p, p + 50)}
        yield k, t, len(t) - len(gone)


def test_all_runs_may_share_a_hash(monkeypatch):
    monkeypatch.setattr(suffix, "_run_hashes", lambda text, size: np.zeros(len(size), np.uint64))
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(6)]
    runs = [rnd.choice(texts)[a:a + 55] for a in (rnd.randint(0, 5) for _ in range(60))]
    text, size = np.frombuffer("".join(runs).encode(), np.uint8), np.full(60, 55)
    order = np.lexsort((np.arange(60), size, np.zeros(60)))
    new = np.zeros(60, bool)
    new[0] = True
    suffix.part_unlike(text, np.arange(60) * 55, size, order, new, slab=7)
    assert new.tolist() == [True, *(a != b for a, b in zip(runs, runs[1:]))]

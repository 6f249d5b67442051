"""Tokenizer alignment against brute force with the libraries."""

import hashlib
import random
from collections import Counter

import pytest

from attesta.llm import align
from attesta.llm.backtrack import byte_alphabet

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def paths():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(docs, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    one.encode_special_tokens = True
    alphabet = byte_alphabet()
    found = []
    for k, text in docs:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [align.piece_bytes(two.id_to_piece(i)) for i in b]
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a = b = bytes_a = bytes_b = []
        ends = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                at += len(p)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [(",".join(str(i) for i, e in zip(a, ends[0]) if lo < e <= hi), ",".join(str(i) for i, e in zip(b, ends[1]) if lo < e <= hi)) for lo, hi in zip([0, *cuts], cuts)]
        links, starts_a, starts_b = [], [0, *ends[0]], [0, *ends[1]]
        j = 0
        for i in range(len(a)):
            while j < len(b) and ends[1][j] <= starts_a[i]:
                j += 1
            m = j
            while m < len(b) and starts_b[m] < ends[0][i]:
                links.append((a[i], b[m]))
                m += 1
        found.append((k, a, b, groups, links))
    counts = Counter(link for x in found for link in x[4])
    most = Counter()
    for (_, t), n in counts.items():
        most[t] = max(most[t], n)
    out = []
    for k, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if groups else ""
        out.append((k, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["the", "Alpha", "tokenizer", "été", "漢字かな", "🙂👍", "x1", "it's", "don't", "12345", "\n", "\n\n", "  ", "zażółć", "\t", "...", "ß", "नमस्ते", "antidisestablishment", "<|endoftext|>", "<s>", "\x00", "▁", "<0x41>"]
    return [(i - 3, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("frequent", [0, 20, 100_000])
def test_equals_brute_force(spark, paths, frequent, monkeypatch):
    docs = [*corpus(1, 60), (500, None), (501, ""), (502, " "), (503, "a"), (None, "so it is"), (None, "so it is"), (7, "so it is"), (7, "other"), (504, "漢字 beta 🙂 " * 300), (505, "xq" * 1500), (506, " " * 700 + "a"), (507, "\n")]
    monkeypatch.setattr(align, "TASK_BYTES", 20_000)
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("doc_id", "text", "1 AS _row", "2 AS n_a", "3 AS a", "4 AS _key")
    if frequent == 100_000:
        got = align.alignment_report(df.repartition(3), *paths).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, paths)
        return
    documents = align.align(df, "text", "doc_id", *paths)
    sums = {r["_row"]: (r.n_best, r.count_sum) for r in align.link_sums(documents, align.pair_counts(documents), frequent).collect()}
    got = [(r["_key"], r.n_a, r.n_b, r.n_groups, len(r.a), *sums.get(r["_row"], (0, 0)), r.groups_sha256) for r in documents.collect()]
    assert sorted(got, key=str) == brute(docs, paths)


def test_groups_and_links_hold_the_same_bytes(spark, paths):
    rows = align.aligned(spark.createDataFrame([(1, "Internationalisierung für 3 Ärzte")], SCHEMA), "text", "doc_id", *paths).orderBy("place").collect()
    assert [r.place for r in rows] == sorted({r.place for r in rows}) and rows[0].new_a and rows[0].new_b
    assert [r.group_id for r in rows] == sorted(r.group_id for r in rows)
    assert {r["_key"] for r in rows} == {1}


def test_empty_tables(spark, paths):
    assert align.alignment_report(spark.createDataFrame([], SCHEMA), *paths).collect() == []
    got = align.alignment_report(spark.createDataFrame([(1, None), (2, "")], SCHEMA), *paths).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_tokens_are_no_rows(spark, paths, monkeypatch):
    """A text's tokens are aligned where it is read: neither they nor their links are dealt out, whatever the size of a step or a slice."""
    monkeypatch.setattr(align, "TASK_BYTES", 100)
    monkeypatch.setattr(align, "SLICE", 7)
    monkeypatch.setattr(align, "HELD", 50)
    docs = corpus(2, 30)
    df = spark.createDataFrame(docs, SCHEMA)
    assert sorted(map(tuple, align.alignment_report(df, *paths).collect()), key=str) == brute(docs, paths)
    plan = align.aligned(df, "text", "doc_id", *paths)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Exchange" not in plan

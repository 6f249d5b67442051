"""Gated ancestors, bounded candidates of fuzzy names, texts cut once, keyword classes and links in order."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.text import keyword_classes
from attesta.operators import chunking, graph, rules
from attesta.sources import files

NODES = "id string, parent_id string, version string"


def climb(nodes, seed, version, depth):
    up, met, front, out = {}, {seed}, [seed], {}
    for i, p, v in nodes:
        if p is not None:
            up.setdefault((i, v), set()).add(p)
    for d in range(1, depth + 1):
        front = sorted({p for n in front for p in up.get((n, version), ())} - met)
        met |= set(front)
        out |= {p: d for p in front}
    return {(seed, version, p, d) for p, d in out.items()}


@pytest.mark.parametrize("depth", [1, 2, 10])
def test_ancestors_keep_to_their_version_and_end_in_cycles(spark, depth):
    rnd = random.Random(depth)
    nodes = [(f"n{i}", f"n{i + 1}", "live") for i in range(12)] + [("n12", "n3", "live"), ("n5", "x", "staged"), ("x", "y", "live"), ("a", "a", "live"), ("b", "c", "live"), ("c", "b", "live"), ("root", None, "live"), ("b", "c", "live")]
    nodes += [(f"r{rnd.randint(0, 15)}", f"r{rnd.randint(0, 15)}", rnd.choice(["live", "staged"])) for _ in range(30)]
    seeds = [("n0", "live"), ("n4", "live"), ("n5", "staged"), ("a", "live"), ("b", "live"), ("b", "live"), ("nowhere", "live"), ("root", "live")] + [(f"r{i}", v) for i in range(16) for v in ("live", "staged")]
    got = graph.ancestors_in_version(spark.createDataFrame(nodes, NODES), spark.createDataFrame(seeds, "id string, version string"), depth).collect()
    assert sorted((r.seed, r.version, r.ancestor, r.distance) for r in got) == sorted(set().union(*(climb(nodes, s, v, depth) for s, v in seeds)))
    assert graph.ancestors_in_version(spark.createDataFrame([], NODES), spark.createDataFrame([], "id string, version string"), depth).collect() == []


def test_few_pairs_of_names_are_compared(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 14)))
    entries = [word() for _ in range(200)]
    names = [e[:-1] + "q" for e in entries[:40]] + [word() for _ in range(40)]
    counted = {}
    got = rules.fuzzy_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(e,) for e in entries], "entry string"), "name", "entry", counted=counted)
    found = {(r.name, r.entry) for r in got.collect()}
    assert {(n, e) for n, e in zip(names[:40], entries) if n != e and len(e) > 5} <= found
    assert counted["pairs"] < len(names) * len(entries) / 10


def test_a_text_travels_once_however_many_pieces_it_has(spark):
    documents = spark.createDataFrame([("d", "abé漢🙂" * 1000), ("e", "")], "doc string, full string")
    pieces = spark.createDataFrame([("d", 5 * i, 5 * i + 5, i) for i in range(1000)] + [("e", 0, 0, 7)], "doc string, at int, stop int, i int")
    rows = chunking.with_own(pieces, documents).collect()
    assert len(rows) == 1001 and {r.own for r in rows if r.doc == "d"} == {"abé漢🙂"} and {r.i for r in rows} == set(range(1000))
    assert "full" not in chunking.bounded(spark.createDataFrame([("d", 0, 2)], "doc string, at int, until int"), documents).columns


def test_keyword_classes(spark):
    df = spark.createDataFrame([("extraction of plants",), ("nothing here",), (None,), ("",)], "t string")
    assert [r.c for r in df.select(keyword_classes(F.col("t"), {"tion": "B", "plant": "A", "extract": "A"}, "Z").alias("c")).collect()] == [["A", "B"], ["Z"], ["Z"], ["Z"]]


def test_of_links_to_one_file_the_last_on_the_page_counts(spark):
    html = '<a href="/laws/a.pdf">Title</a> <a href="/laws/b.pdf">B</a> <a href="/laws/a.pdf">other</a> <a href="/laws/b.pdf"><b>title</b></a>'
    pages = spark.createDataFrame([(1, "https://h.org/x", "TITLE", html), (2, "https://h.org/x", "T", None)], "page_id int, url string, title string, html string").repartition(3)
    links = files.anchors(pages, "page_id", "html")
    assert [(r.place, r.text) for r in links.orderBy("place").collect()] == [(0, "Title"), (1, "B"), (2, "other"), (3, "title")]
    got = {r.page_id: (r.url, r.error) for r in files.single_candidate(links.repartition(5), pages, "page_id", "h.org", "/laws/").collect()}
    assert got == {1: ("https://h.org/laws/b.pdf", None), 2: (None, "none")}

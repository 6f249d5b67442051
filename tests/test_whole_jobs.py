"""Queries over whole tables: small odd tables against their SQL and against plain Python."""

import os
import random

import pytest

from attesta.plans import catalog


def both(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}/*.parquet')")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    rows = sorted((tuple(r) for r in got.select(*order).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return [dict(zip(order, r, strict=True)) for r in rows]


@pytest.mark.parametrize("parts", [0, 3, 700])
def test_ipc_lookup_classes_all_parts_and_documents(spark, tmp_path, parts):
    texts = {i: "a ration" if i == 299 else "able" if i % 2 else None if i == 4 else "eux nation" if i == 6 else "" for i in range(300) if i != 50}
    rows = [*texts.items(), (-7, "Freiheit"), (9000, "a nation able"), (6, "Freiheit")]  # gaps, negative and far ids, an id twice
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k,) for k in range(parts)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = both(spark, tmp_path, "ipc_lookup")
    assert sorted(r["p_partkey"] for r in got if r["p_partkey"] is not None) == list(range(parts))
    assert {r["doc_id"] for r in got} - {None} == {k for k, _ in rows}
    of = {r["doc_id"]: r["classes"] for r in got if r["doc_id"] is not None}
    assert (of[299], of[4], of[6], of[-7], of[9000], of[151]) == ("A61K", "A61K 36/00", "A23L,A61K,C12N", "C12N", "A61K,A61P", "A61P")
    by_part = {r["p_partkey"]: r for r in got}
    if parts == 700:
        assert [by_part[k]["doc_id"] for k in (0, 50, 299, 301, 302, 601)] == [0, None, 299, None, 0, 299] and by_part[601]["classes"] == "A61K" and by_part[50]["classes"] == "A61K 36/00"


COUNTED = {  # doc_id: text, units, edges
    0: ("(1) one (2) two Provided that x", 9, 2), 4: ("plain", 6, 1), 8: (None, 6, 1), 1: ("Article 99999999999\nArticle 100000000000", 5, 0), 5: ("\nArticle 4\nArticle 7 Title", 5, 0), 9: ("", 3, 0),
    2: (None, 2, 0), 6: ("Rule 3\nRule 1\nRule 4", 4, 0), 10: ("CHAPTER I\nno rule", 3, 0), 3: ("1. Short title.—This. 2. Definitions.—In this, (a) x (b) y Explanation.—z", 5, 1), 7: ("Article 1\na\nArticle 2\nb\nArticle 3\nc", 3, 0),
    11: ("a\n\nb\n12 c", 3, 0), 15: ("", 0, 0), 19: (None, 0, 0), 23: (" \t\n", 0, 0), -1: ("", 0, 0), -4: ("", 6, 1), 27: ("१. Some title.—(१) one (२) two", 3, 0), 31: ("1. Some title.—abc \u2028", 1, 0),
    35: ("1. Some title.—(1) in (a) x (b) y Provided that it is (2) more. 3. (1) a 3. Again one.—b 4. Fill 2. Low one.—c 5. [Old.] Omitted 6. Last of all.—d", 12, 1), 39: ("1. First title.—one. 2. Second title.—" + "word " * 2000 + "(a) x (b) y", 2, 0),
}
PIECES = [
    "1. Short title.—This ", "2. Definitions,—In ", "4. [x 6. [y] Omitted ", "5. (1) The ", "section 6. (2) no ", "4. No person ", "8A. Other thing.-x ", "13. Qqqq.—", "(1) ", "(2) ", "(3) ", "(a) ", "(b) ", "(aa) ", "Provided that ", "Provided also: ", "Explanation 1.—y ",
    "\nArticle 1\n", "\nArticle 2\n", "\nArticle 3\n", "\nArticle 1A\n", "see Article 2 ", "\nRule 1\n", "\nRule 3.\n", "\nrule 2A\n", "see rule 3 ", "\nCHAPTER I\n", "CHAPTER III POWERS AND DUTIES ", "XCHAPTER I", "word ", "é ü ", "\u3000", "\x0b", "3[amended]", "4* * *", "\n\n", "\nRule ٣\n",
]


def test_chunk_counts_counts_units_and_edges_of_whole_documents(spark, tmp_path):
    r = random.Random(4)
    texts = {1000 + i: "".join(r.choices(PIECES[:17] if i % 3 else PIECES, k=r.randint(1, 25))) for i in range(300)}
    rows = [(k, t, "en", "s") for k, t in {**{k: v[0] for k, v in COUNTED.items()}, **texts}.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc"]: r for r in both(spark, tmp_path, "chunk_counts")}
    assert {k: (got[k]["n_units"], got[k]["n_edges"]) for k in COUNTED} == {k: v[1:] for k, v in COUNTED.items()}
    assert set(got) == set(COUNTED) | set(texts) and all(r["has_units"] == (r["n_units"] > 0) for r in got.values())

"""Structural chunking of small legal documents."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import chunking

SCHEMA = "doc string, doc_type string, page int, printed int, raw string"
ACT = [
    "ARRANGEMENT OF SECTIONS\nCHAPTER I\nPRELIMINARY\n1. Short title.\n2. Definitions.",
    "THE ACT\nCHAPTER I\nPRELIMINARY\n1. Short title.—This Act may be called the Act. 2. Definitions.—In this Act, unless the context otherwise requires, (a) “one” means 1; (c) “two” means 2 "
    "Explanation.—Two is even; 3. What are not inventions.—(1) The following: (a) a frivolous invention; (b) a mere discovery Provided that it is new; (2) Nothing in section 88. (3) of it counts. 4. No person shall do so. "
    "5. [Old heading.] Omitted by the Act of 2002.",
    "CHAPTER II\nAUTHORITIES\n6. (1) The Board shall sit. (2) It shall rise. 6. Repeated heading.—Again the same number. 7. Last one.—The end.",
]


@pytest.fixture(scope="module")
def cut(spark):
    treaty = "Article 1\nScope\nThis is about scope, see Article 3.\nArticle 2\nUse\nUse it.\nArticle 3\nEnd\nIt ends."
    rules = "Rule 1\nShort title.\nThese are rules.\nCHAPTER II\nRule 2\nForms\nUse forms as Rule 1 says.\nRule 19A\nFees\nPay."
    rows = [("act", "statute", i, i + 1, t) for i, t in enumerate(ACT)]
    rows += [("treaty", "treaty", 0, 1, treaty), ("rules", "rule", 0, 1, rules), ("booklet", "treaty", 0, 1, "Article 3\nx\nArticle 4\ny"), ("booklet", "treaty", 1, 2, "Article 1\na\nArticle 2\nb"), ("notice", "notification", 0, 7, "A plain notice. 12 words."), ("blank", "statute", 0, 1, "  \n "), ("none", "statute", 0, 1, None)]
    units, edges, warnings = chunking.chunk_documents(spark.createDataFrame(rows, SCHEMA))
    _, documents = chunking.parsed(spark.createDataFrame(rows, SCHEMA))
    return units.join(documents.select("doc", "full"), "doc").collect(), edges.collect(), {(r.doc, r.warning) for r in warnings.collect()}


def of(units, doc):
    return {r.key.split("#")[1]: r for r in units if r.doc == doc}


def test_texts_are_verbatim(cut):
    assert all(r.full[r.start:r.end] == r.text and r.text == r.text.strip() for r in cut[0] if r.text)
    assert len({(r.doc, r.key) for r in cut[0]}) == len(cut[0])


def test_sections_clauses_and_provisos(cut):
    act = of(cut[0], "act")
    assert list(act) and set(act) == {"s1", "s2", "s2(a)", "s2(c)", "s2(c)-explanation", "s3", "s3(1)", "s3(1)(a)", "s3(1)(b)-proviso", "s3(1)(b)", "s3(2)", "s3(3)", "s4", "s5", "s6", "s6(1)", "s6(2)", "s6-p3", "s7"} - ({"s3(1)(b)-proviso"} if "s3(1)-proviso" in act else set()) | ({"s3(1)-proviso"} if "s3(1)-proviso" in act else set())
    assert act["s1"].text.startswith("1. Short title.—This Act") and act["s1"].path == ["Chapter I", "Preliminary", "Section 1", "Short title"] or act["s1"].path[0].startswith("Chapter I")
    assert act["s2(c)"].parent == "act#s2" and act["s2(c)-explanation"].text.startswith("Explanation.—Two is even")
    assert act["s3(1)(a)"].parent == "act#s3(1)" and act["s3(1)(a)"].text == "(a) a frivolous invention;"
    assert act["s4"].heading is None and act["s4"].text.startswith("4. No person") and act["s5"].heading == "Old heading."
    assert act["s6(1)"].path[0].startswith("Chapter II") and (act["s6"].page_start, act["s1"].page_start) == (3, 2)
    assert {(e.src, e.dst) for e in cut[1]} >= {("act#s2(c)", "act#s2(c)-explanation")} and all(e.kind == "proviso_of" for e in cut[1])
    assert ("act", "repeated_heading") in cut[2]


def test_other_kinds_of_documents(cut):
    units, _, warnings = cut
    assert [k for k in of(units, "treaty")] and set(of(units, "treaty")) == {"art1", "art2", "art3"} and of(units, "treaty")["art1"].path == ["Article 1", "Scope"]
    assert of(units, "treaty")["art1"].text.endswith("see Article 3.")
    rules = of(units, "rules")
    assert set(rules) == {"r1", "r2", "r19A"} and rules["r1"].text.endswith("These are rules.") and rules["r2"].heading == "Forms"
    assert set(of(units, "booklet")) == {"p1", "p2"} and {("booklet", "incomplete_articles"), ("booklet", "page_chunks")} <= warnings
    assert set(of(units, "notice")) == {"p7"} and ("notice", "no_headings") in warnings
    assert not of(units, "blank") and not of(units, "none")


def test_long_tails_are_cut_with_a_warning(spark):
    rows = [("d", "statute", 0, 1, "1. First title.—one. 2. Second title.—" + "word " * 2000)]
    units, _, warnings = chunking.chunk_documents(spark.createDataFrame(rows, SCHEMA))
    got = of(units.collect(), "d")
    assert len(got["s2"].text) <= chunking.TAIL + 30 and {r.warning for r in warnings.collect()} == {"unbounded_tail"}
    assert chunking.chunk_documents(spark.createDataFrame([], SCHEMA))[0].collect() == []


def test_marks_have_offsets(spark):
    df = spark.createDataFrame([(1, "é (1) a (2) b"), (2, None)], "k int, t string")
    got = chunking.marks(df, ["k"], "t", chunking.NUMBERED).orderBy("at").collect()
    assert [(r.number, r.at, r.until) for r in got] == [("1", 2, 6), ("2", 8, 12)]
    assert chunking.marks(df.withColumn("s", F.lit(3)), ["k"], "t", chunking.NUMBERED, "s").count() == 1

"""Structural chunking of legal documents: articles, rules, sections with clauses, or pages.

Pages come as rows (doc, page, raw). A small helper finds where patterns match; everything else - which headings are kept, where units
end, what their keys and paths are - are joins and windows over those matches, so that documents of any number and length are spread
over tasks. A unit's text is what the document's text holds between its offsets.

A document is cut by the first way that fits: articles, if the headings make one ordered run; pages, if there are article headings but
no such run; rules, for documents of type rule with two ordered rule headings; sections; else pages. Pages without text give no unit,
null pages count as empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions.text import page_clean, section_order
from attesta.operators.structure import increasing_prefix, longest_increasing_rows, page_offsets, proviso_split, sequential_run
from attesta.session import materialize

#: Shapes of headings and markers. Group 1 is the number or label, group 2 the title.
NOT_CITED = r"(?<!section )(?<!Section )(?<!sections )(?<!Sections )"
BODY = r"(?sU)^(.*)\bCHAPTER[\s\x1c-\x1f-]+I\b"
SECTIONS = {
    "titled": r"(?<!\d)(\d{1,3}[A-Z]{0,2})\.\s+([A-Z][^.]{2,160}?)[,.]\s*[—-]",
    "omitted": r"(?<!\d)(\d{1,3}[A-Z]{0,2})\.\s+(\[[^\]]*\])\s*(?=Omitted\b)",
    "untitled": NOT_CITED + r"(?<!\d)(\d{1,3}[A-Z]{0,2})\.\s+()(?=\(\d+\))",
    "plain": NOT_CITED + r"(?<!\d)(\d{1,3})\.\s+()(?=[A-Z])",
}
CHAPTER = {"chapter": r"\bCHAPTER[\s-]+([IVXLCDM]+)\b\s*([A-Z][A-Z ,\-]{2,80})?"}
ARTICLE_LINE = {"article": r"(?m)^[ \t]*[Aa][Rr][Tt][Ii][Cc][Ll][Ee][ \t]*(?:\r?\n[ \t]*)?(\d+[A-Z]?)[ \t.:—–-]*(?:([A-Z][^\r\n]*))?[ \t]*$"}
ARTICLE_NAME = {"article": r"(?i)Article[ \t]+(\d+[A-Z]?)\b()"}
RULE_LINE = {"rule": r"(?im)^[ \t]*Rule[ \t]+(\d{1,3}[A-Z]{0,2})\.?[ \t]*$()"}
RULE_NAME = {"rule": r"(?i)Rule[ \t]+(\d{1,3}[A-Z]{0,2})\b()"}
CHAPTER_LINE = {"chapter": r"(?im)^[ \t]*CHAPTER[ \t]+[IVXLCDM]+\b[^\r\n]*()()"}
NUMBERED = {"numbered": r"(?<!\S)\((\d{1,3})\)\s()"}
LETTERED = {"lettered": r"(?<!\S)\(([a-z]{1,3})\)\s()"}
#: What every text with a match of the shape holds, in small letters, for Spark to pass over the others; of sections a number and a dot.
HINTS = {"chapter": "chapter", "article": "article", "rule": "rule", "numbered": "(", "lettered": "("}
NUMBER = r"\p{Nd}[A-Z]{0,2}\.[^\p{L}\p{Nd}]"
#: Characters that the last unit of a document may run on past its heading.
TAIL = 4000
#: Decimal digits of all scripts, as ASCII digits.
DIGITS = {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}


def hinted(df: DataFrame, text: str, shapes: dict[str, str]) -> DataFrame:
    """The rows whose text can have a match of the shapes."""
    words = {HINTS.get(kind) for kind in shapes}
    held = [F.contains(F.lower(text), F.lit(word)) if word else F.col(text).rlike(NUMBER) for word in words]
    return df.where(reduce(lambda a, b: a | b, held))


def marks(df: DataFrame, keys: list[str], text: str, shapes: dict[str, str], start: str | None = None) -> DataFrame:
    """keys, kind, number, title, at and until of every match of the shapes in a text column, from a place on if start names one.

    Offsets count characters from 0. Digits of any script are digits, and ASCII digits in number. Null texts have no matches.
    """
    compiled = {kind: re.compile(shape) for kind, shape in shapes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (t, begin) in enumerate(zip(batch["_text"].to_pylist(), batch["_from"].to_pylist(), strict=True)):
                for kind, shape in compiled.items():
                    for m in shape.finditer(t or "", begin or 0):
                        rows.append(i)
                        found.append((kind, (m.group(1) or "").translate(DIGITS), (m.group(2) or "").strip(), m.start(), m.end()))
            kept = batch.select(keys).take(pa.array(rows, pa.int64()))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            columns = [pa.array([f[j] for f in found], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*keys, "kind", "number", "title", "at", "until"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return hinted(df, text, shapes).select(*keys, F.col(text).alias("_text"), (F.col(start) if start else F.lit(0)).cast("int").alias("_from")).mapInArrow(run, f"{schema}, kind string, number string, title string, at int, until int")


def parsed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages with text (cleaned) and start (its offset in the document), and documents: doc, doc_type, full and body (where the text itself begins).

    The body begins at the last `CHAPTER I`, which skips a table of contents; at 0 without one. Pages are joined by a line feed.
    """
    near = pages.withColumn("raw", F.coalesce("raw", F.lit(""))).repartition("doc").withColumn("text", page_clean(F.col("raw")))
    clean = page_offsets(near, "doc", "page", "text").withColumn("start", F.col("start").cast("int"))
    joined = clean.groupBy("doc").agg(F.first("doc_type").alias("doc_type"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    full = joined.select("doc", "doc_type", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("full"))
    body = F.when(F.contains("full", F.lit("CHAPTER")), F.length(F.regexp_extract("full", BODY, 1))).otherwise(0)
    return clean, full.withColumn("body", body.cast("int"))


def at_or_after(asked: DataFrame, found: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """asked with value: that of the first row of found (keys, place, value) at or after the place; null without any. One sort, no range join."""
    both = asked.withColumn(value, F.lit(None).cast(found.schema[value].dataType)).withColumn("_k", F.lit(0)).unionByName(found.select(*keys, place, value).withColumn("_k", F.lit(1)), allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy(place, "_k").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(value, F.first(value, ignorenulls=True).over(ahead)).where("_k = 0").drop("_k")


def at_or_before(asked: DataFrame, found: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """asked with value: that of the last row of found before the place (not at it); null without any."""
    both = asked.withColumn(value, F.lit(None).cast(found.schema[value].dataType)).withColumn("_k", F.lit(0)).unionByName(found.select(*keys, place, value).withColumn("_k", F.lit(1)), allowMissingColumns=True)
    behind = Window.partitionBy(*keys).orderBy(place, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(behind)).where("_k = 0").drop("_k")


def line_headings(pages: DataFrame, line: dict[str, str], name: dict[str, str] | None) -> DataFrame:
    """doc, number, title, at and until (in the document's text) of headings that stand on a line of their own in the raw page.

    A raw match is led to the cleaned text by the length of what cleaning leaves of the page before it; the first name at or after that
    place must have the same number. A heading without a title takes the next line that isn't blank.
    """
    pages = hinted(pages, "raw", line)
    found = marks(pages, ["doc", "page"], "raw", line).groupBy("doc", "page").agg(F.collect_list(F.struct("number", "title", "at", "until")).alias("_m"))

    def derived(m: Column) -> Column:
        rest = F.split(F.substr("raw", m["until"] + 1), r"\r?\n")
        nextline = F.coalesce(F.try_element_at(F.filter(F.transform(rest, lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit(""))
        title = F.regexp_replace(F.trim(F.when(m["title"] != "", m["title"]).otherwise(nextline)), r"\s+", " ")
        return F.struct(m["number"].alias("number"), title.alias("title"), F.length(page_clean(F.substr("raw", F.lit(1), m["at"]))).alias("place"), m["at"].alias("raw_at"))

    led = pages.select("doc", "page", "raw", F.col("start").alias("page_start")).join(found, ["doc", "page"])
    asked = led.select("doc", "page", "page_start", F.explode(F.transform("_m", derived)).alias("_h")).select("doc", "page", "page_start", "_h.*")
    clean = marks(pages, ["doc", "page"], "text", name or CHAPTER).select("doc", "page", F.col("at").alias("place"), F.struct("number", "at", "until").alias("met"))
    met = at_or_after(asked, clean, ["doc", "page"], "place", "met").where("met IS NOT NULL")
    same = met if name is None else met.where(F.lower("met.number") == F.lower("number"))
    return same.select("doc", "number", "title", (F.col("page_start") + F.col("met.at")).alias("at"), (F.col("page_start") + F.col("met.until")).alias("until"), "page", "raw_at")


def article_run(headings: DataFrame) -> DataFrame:
    """The headings of each document's article run: the longest row of increasing numbers that begins with 1, the later of equal ones.

    Documents whose run has fewer than three headings, or leaves a number out that another heading has, give none.
    """
    order = Window.partitionBy("doc").orderBy("page", "raw_at")
    digits = F.regexp_replace(F.regexp_extract("number", r"^(\d+)", 1), "^0+(?=.)", "")
    key = F.struct(F.length(digits).alias("size"), digits.alias("n"), F.regexp_extract("number", r"^\d+(.*)$", 1).alias("s"))  # numbers of any length
    ordered = headings.withColumn("_key", key).withColumn("_break", F.when(F.coalesce(F.col("_key") > F.lag("_key").over(order), F.lit(False)), 0).otherwise(1))
    runs = ordered.withColumn("_run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    led = runs.withColumn("_led", F.max(F.when(F.col("_key.n") == "1", 1).otherwise(0)).over(Window.partitionBy("doc", "_run").orderBy("page", "raw_at").rowsBetween(Window.unboundedPreceding, 0))).where("_led = 1")
    best = led.groupBy("doc", "_run").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.array_sort(F.collect_set("number")).alias("own")).where("n >= 3")
    best = best.groupBy("doc").agg(F.max_by(F.struct("_run", "own"), F.struct("n", "first")).alias("b"))
    every = headings.groupBy("doc").agg(F.array_sort(F.collect_set("number")).alias("every"))
    whole = best.join(every, "doc").where("b.own = every").select("doc", F.col("b._run").alias("_run"))
    return led.join(whole, ["doc", "_run"], "left_semi").select("doc", "number", "title", "at", "until")


def rule_run(headings: DataFrame, documents: DataFrame) -> DataFrame:
    """The longest increasing row of rule headings in the body of documents of type rule, where it has two or more."""
    inside = headings.join(documents.where("doc_type = 'rule'").select("doc", "body"), "doc").where("at >= body").withColumn("order", section_order(F.col("number")))
    kept = longest_increasing_rows(inside.select("doc", "at", "order"), "doc", "at", "order").select("doc", "at")
    run = inside.dropDuplicates(["doc", "at"]).join(kept, ["doc", "at"], "left_semi")
    return run.withColumn("_n", F.count("*").over(Window.partitionBy("doc"))).where("_n >= 2").select("doc", "number", F.regexp_replace("title", r"^[. ]+|[. ]+$", "").alias("title"), "at", "until")


def section_starts(documents: DataFrame, others: DataFrame) -> DataFrame:
    """Section headings of each document's body, but for the documents in others: doc, number, title, at and until, in rising order of their numbers.

    Matches of the three shapes are merged by their place; numbers below an earlier one are cross-references and go; where two
    neighbours differ by 2, a plain number between them fills the gap.
    """
    found = marks(documents, ["doc"], "full", SECTIONS, "body").join(others, "doc", "left_anti")
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("kind"))
    first = Window.partitionBy("doc", "at").orderBy(rank)
    shaped = found.where("kind <> 'plain'").withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("_o", section_order(F.col("number")))
    order = Window.partitionBy("doc").orderBy("at")
    rising = shaped.withColumn("_m", F.max("_o").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_o = _m").drop("_r", "_m", "_o")
    digits = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.col(c).cast("int"))
    gaps = rising.withColumn("_n", digits("number")).withColumn("_next", F.lead("_n").over(order)).withColumn("_end", F.lead("at").over(order)).where("_next - _n = 2").select("doc", (F.col("_n") + 1).cast("string").alias("number"), F.col("until").alias("_low"), F.col("_end").alias("_high"))
    filled = found.where("kind = 'plain'").join(gaps, ["doc", "number"]).where("at >= _low AND until <= _high").withColumn("_r", F.row_number().over(Window.partitionBy("doc", "number", "_low").orderBy("at"))).where("_r = 1")
    return rising.select("doc", "number", "title", "at", "until").unionByName(filled.select("doc", "number", "title", "at", "until")).dropDuplicates(["doc", "at"])


def bounded(headings: DataFrame, documents: DataFrame) -> DataFrame:
    """headings with stop (where the next one begins, or TAIL characters past the last heading) and cut (the last unit was cut); offsets only, no text."""
    order = Window.partitionBy("doc").orderBy("at")
    joined = headings.join(documents.select("doc", F.length("full").alias("_size")), "doc").withColumn("_next", F.lead("at").over(order))
    long = F.col("_next").isNull() & (F.col("_size") - F.col("until") > TAIL)
    return joined.withColumn("cut", long).withColumn("stop", F.coalesce("_next", F.when(long, F.col("until") + TAIL).otherwise(F.col("_size")))).drop("_next", "_size")


def with_own(pieces: DataFrame, documents: DataFrame, at: str = "at", stop: str = "stop") -> DataFrame:
    """pieces (doc, offsets and more) with own, the text between two offsets. A document's offsets are gathered and meet its text once, so a text travels once, however many pieces it has."""
    held = pieces.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in pieces.columns if c != "doc"])).alias("_p"))
    cut = lambda x: F.struct(x.alias("x"), _slice("full", x[at], x[stop]).alias("own"))
    return documents.select("doc", "full").join(held, "doc").select("doc", F.explode(F.transform("_p", cut)).alias("_q")).select("doc", "_q.x.*", "_q.own")


def _slice(full: str, start: Column, stop: Column) -> Column:
    return F.substr(full, start + 1, F.greatest(stop - start, F.lit(0)))


def _rtrim(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


UNIT = ["doc", "key", "parent", "path", "heading", "text", "start"]


def _unit(key: Column, parent: Column, path: Column, heading: Column, text: Column, start: Column) -> list[Column]:
    return [F.col("doc"), key.alias("key"), parent.cast("string").alias("parent"), path.alias("path"), heading.cast("string").alias("heading"), text.alias("text"), start.cast("int").alias("start")]


def _titled(prefix: str) -> Column:
    return F.when(F.col("title") != "", F.array(F.concat(F.lit(prefix), "number"), "title")).otherwise(F.array(F.concat(F.lit(prefix), "number")))


def _piece(kind: str, key: Column, path: Column, heading: Column) -> list[Column]:
    return [F.col("doc"), F.lit(kind).alias("kind"), key.alias("key"), path.alias("path"), heading.alias("heading"), F.col("at"), F.col("until"), F.col("stop")]


def article_pieces(run: DataFrame, documents: DataFrame) -> DataFrame:
    return bounded(run, documents).select(*_piece("article", F.concat("doc", F.lit("#art"), "number"), _titled("Article "), F.nullif("title", F.lit(""))))


def rule_pieces(run: DataFrame, documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rules end where a chapter begins before the next one."""
    named = at_or_after(bounded(run, documents).withColumn("place", F.col("until") + 1), chapters.select("doc", F.col("at").alias("place"), F.col("at").alias("chapter")), ["doc"], "place", "chapter")
    stop = F.when(F.col("chapter") < F.col("stop"), F.col("chapter")).otherwise(F.col("stop"))
    return named.withColumn("stop", stop).select(*_piece("rule", F.concat("doc", F.lit("#r"), "number"), _titled("Rule "), F.nullif("title", F.lit(""))))


def whole_units(pieces: DataFrame) -> DataFrame:
    """Units of articles and rules: all of their text."""
    return pieces.select(*_unit(F.col("key"), F.lit(None), F.col("path"), F.col("heading"), _rtrim(F.col("own")), F.col("at")))


def page_units(pages: DataFrame) -> DataFrame:
    number = F.col("printed").cast("string")
    return pages.where("text <> ''").select(*_unit(F.concat("doc", F.lit("#p"), number), F.lit(None), F.array(F.concat(F.lit("Page "), number)), F.lit(None), F.col("text"), F.col("start")))


def page_of(units: DataFrame, pages: DataFrame, place: str, name: str) -> DataFrame:
    """units with the printed number of the page that holds a place (the first page before any start)."""
    starts = pages.select("doc", F.col("start").alias("_at"), F.col("printed").alias(name))
    return at_or_before(units.withColumn("_at", F.col(place) + 1), starts, ["doc"], "_at", name).drop("_at")


def clause_rows(bodies: DataFrame, key: str, text: str, numbered: bool = True) -> DataFrame:
    """key, label, at and stop of the clauses of each text: (1) (2) ... from the start on, or (a) (b) ... in rising order, whichever comes first.

    A lone letter is no list. Offsets are into the text; a clause ends where the next one begins.
    """
    found = marks(bodies, [key], text, NUMBERED | LETTERED if numbered else LETTERED)
    digits = found.where("kind = 'numbered'").withColumn("_n", F.col("number").cast("int"))
    begins = F.min("at").over(Window.partitionBy(key))
    digits = sequential_run(digits.withColumn("_b", begins).where("_b <= 5").drop("_b"), key, "at", "_n").drop("_n")
    letters = increasing_prefix(found.where("kind = 'lettered'"), key, "at", "number")
    both = digits.unionByName(letters)
    first = both.withColumn("_f", F.first("kind").over(Window.partitionBy(key).orderBy("at"))).where("kind = _f")
    sized = first.join(bodies.select(key, F.length(text).alias("_size")), key)
    return sized.withColumn("stop", F.coalesce(F.lead("at").over(Window.partitionBy(key).orderBy("at")), F.col("_size"))).select(key, F.concat(F.lit("("), "number", F.lit(")")).alias("label"), "at", "stop")


def section_pieces(starts: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections end where a chapter begins before the next one; a number met before takes its page."""
    chapters = marks(documents, ["doc"], "full", CHAPTER, "body").select("doc", F.col("at").alias("_p"), F.struct("at", F.when(F.col("title") != "", F.array(F.concat(F.lit("Chapter "), "number"), F.initcap("title"))).otherwise(F.array(F.concat(F.lit("Chapter "), "number"))).alias("path")).alias("chapter"))
    own = at_or_before(bounded(starts, documents).withColumn("_p", F.col("at")), chapters, ["doc"], "_p", "chapter")
    inside = at_or_before(own.withColumn("_p", F.col("stop")), chapters.withColumnRenamed("chapter", "later"), ["doc"], "_p", "later").drop("_p")
    ends = F.when(F.col("later.at") >= F.col("until"), F.col("later.at")).otherwise(F.col("stop"))
    paged = page_of(inside.withColumn("stop", ends), pages, "at", "page")
    base = F.concat("doc", F.lit("#s"), "number")
    nth = Window.partitionBy("doc", "number").orderBy("at")
    again = Window.partitionBy("doc", "number", "page", "_again").orderBy("at")
    keyed = paged.withColumn("_again", F.row_number().over(nth) > 1).withColumn("_n", F.row_number().over(again))
    key = F.when(~F.col("_again"), base).otherwise(F.concat(base, F.lit("-p"), F.col("page").cast("string"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise("")))
    heading = F.nullif(F.regexp_replace(F.trim("title"), r"^[\[\]]+|[\[\]]+$", ""), F.lit(""))
    path = F.concat(F.coalesce("chapter.path", F.array().cast("array<string>")), F.array(F.concat(F.lit("Section "), "number")), F.when(heading.isNotNull(), F.array(heading)).otherwise(F.array().cast("array<string>")))
    return keyed.select(*_piece("section", key, path, heading))


def section_units(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and edges (doc, src, dst, kind) of stored sections, their clauses, clauses inside numbered ones, and provisos and explanations.

    Each level is stored before the next is sought in it, so no text is cut twice and plans stay small.
    """
    raw = _slice("own", F.col("until") - F.col("at"), F.col("stop") - F.col("at"))
    left = F.length(raw) - F.length(F.regexp_replace(raw, r"^\s+", ""))
    sections = stored.select("*", (F.col("until") + left).alias("inner"), _rtrim(F.regexp_replace(raw, r"^\s+", "")).alias("body"))

    clauses = clause_rows(sections, "key", "body").join(sections.select("doc", "key", "path", "inner", "body"), "key")
    split = _rtrim(_slice("body", F.col("at"), F.col("stop")))
    level = materialize(clauses.select("doc", F.col("key").alias("parent"), F.concat("key", "label").alias("key"), "label", F.concat("path", F.array(F.concat(F.lit("clause "), "label"))).alias("path"), (F.col("inner") + F.col("at")).alias("start"), proviso_split(split).alias("p")), "clauses")
    lists = clause_rows(level.where(F.col("label").rlike(r"^\(\d+\)$")).select("key", F.col("p.body").alias("body")), "key", "body", False).withColumnRenamed("label", "below").join(level, "key")
    sub = materialize(lists.select("doc", F.col("key").alias("parent"), F.concat("key", "below").alias("key"), F.concat("path", F.array(F.concat(F.lit("clause "), "below"))).alias("path"), (F.col("start") + F.col("at")).alias("start"), proviso_split(_rtrim(_slice("p.body", F.col("at"), F.col("stop")))).alias("p")), "clauses")

    firsts = level.groupBy(F.col("parent").alias("key")).agg(F.min("start").alias("_first"))
    heads = stored.join(firsts, "key", "left")
    units = heads.select(*_unit(F.col("key"), F.lit(None), F.col("path"), F.col("heading"), _rtrim(_slice("own", F.lit(0), F.coalesce("_first", "stop") - F.col("at"))), F.col("at")))
    opened = sub.groupBy(F.col("parent").alias("key")).agg(F.min("start").alias("_first"))
    led = level.join(opened, "key", "left")
    head = F.when(F.col("_first").isNotNull(), _rtrim(F.substr("p.body", F.lit(1), F.col("_first") - F.col("start")))).otherwise(F.col("p.body"))
    units = units.unionByName(led.select(*_unit(F.col("key"), F.col("parent"), F.col("path"), F.lit(None), head, F.col("start"))))
    units = units.unionByName(sub.select(*_unit(F.col("key"), F.col("parent"), F.col("path"), F.lit(None), F.col("p.body"), F.col("start"))))
    split_off = level.select("doc", "key", "path", "start", "p").unionByName(sub.select("doc", "key", "path", "start", "p")).where("p.kind IS NOT NULL")
    child = F.concat("key", F.lit("-"), "p.kind")
    children = split_off.select(*_unit(child, F.col("key"), F.concat("path", F.array(F.initcap("p.kind"))), F.initcap("p.kind"), _rtrim(F.col("p.child")), F.col("start") + F.col("p.at")))
    edges = split_off.select("doc", F.col("key").alias("src"), child.alias("dst"), F.lit("proviso_of").alias("kind"))
    return units.unionByName(children), edges


def stored(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parsed pages and documents, written and read back. Pages are cleaned again where their text is read."""
    pages, documents = parsed(pages)
    return materialize(pages.drop("text"), "chunking").withColumn("text", page_clean(F.col("raw"))), materialize(documents, "chunking")


def cut_documents(pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units without their pages (doc, key, parent, path, heading, text, start, end), edges and warnings of stored pages and documents."""
    articles = line_headings(pages, ARTICLE_LINE, ARTICLE_NAME).checkpoint()
    run = article_run(articles)
    by_articles, tried = run.select("doc").distinct(), articles.select("doc").distinct()
    left = documents.select("doc", "doc_type", "body").join(tried, "doc", "left_anti")
    rules = rule_run(line_headings(pages, RULE_LINE, RULE_NAME), left).checkpoint()
    ruled = rules.select("doc").distinct()
    starts = section_starts(documents, tried.unionByName(ruled)).checkpoint()
    left = left.select("doc").join(ruled, "doc", "left_anti").join(starts.select("doc").distinct(), "doc", "left_anti")
    paged = left.unionByName(tried.join(by_articles, "doc", "left_anti"))
    pieces = article_pieces(run, documents).unionByName(rule_pieces(rules, documents, line_headings(pages, CHAPTER_LINE, None))).unionByName(section_pieces(starts, documents, pages))
    pieces = materialize(with_own(pieces, documents), "pieces")
    sections, edges = section_units(pieces.where("kind = 'section'"))
    plain = page_units(pages.drop("text").join(paged, "doc", "left_semi").withColumn("text", page_clean(F.col("raw"))))
    units = whole_units(pieces.where("kind <> 'section'")).unionByName(sections).unionByName(plain)
    units = materialize(units.withColumn("end", F.col("start") + F.length("text")), "units")
    warned = lambda df, text: df.select("doc", F.lit(text).alias("warning"))
    cut = bounded(run, documents).unionByName(bounded(rules, documents)).unionByName(bounded(starts, documents)).where("cut").select("doc")
    repeated = units.where(F.col("key").rlike(r"#s[^(]*-p\d+(-\d+)?$")).select("doc").distinct()
    warnings = [warned(cut, "unbounded_tail"), warned(repeated, "repeated_heading"), warned(tried.join(by_articles, "doc", "left_anti"), "incomplete_articles"), warned(left, "no_headings"), warned(plain.select("doc").distinct(), "page_chunks")]
    return units, edges, reduce(DataFrame.unionByName, warnings)


def chunk_documents(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units (doc, key, parent, path, heading, text, start, end, page_start, page_end), edges (doc, src, dst, kind) and warnings (doc, warning).

    pages: doc, doc_type, page, printed (its printed number) and raw.
    """
    pages, documents = stored(pages)
    units, edges, warnings = cut_documents(pages, documents)
    placed = page_of(page_of(units.withColumn("_last", F.greatest(F.col("end") - 1, F.col("start"))), pages, "start", "page_start"), pages, "_last", "page_end").drop("_last")
    return placed, edges, warnings

"""Ordered runs and structural chunking of documents."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def page_offsets(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """pages with start: where the page begins in the document's text, pages joined by one character."""
    size = F.length(text) + 1
    return pages.withColumn("start", (F.sum(size).over(by(doc, page).rowsBetween(Window.unboundedPreceding, 0)) - size).cast("bigint"))


def page_at(offsets: DataFrame, pages: DataFrame, doc: str, offset: str, page: str = "page", start: str = "start") -> DataFrame:
    """offsets with the last page that begins at or before the offset: both are sorted together once, no range join."""
    every = pages.select(doc, F.col(start).alias(offset), F.col(page).alias("_page"), F.lit(0).alias("_kind")).unionByName(offsets.select(doc, offset).withColumn("_page", F.lit(None).cast(pages.schema[page].dataType)).withColumn("_kind", F.lit(1)))
    seen = every.withColumn(page, F.last("_page", ignorenulls=True).over(by(doc, offset, "_kind").rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where("_kind = 1").select(doc, offset, page)


def slices(headings: DataFrame, doc: str, start: str, end: str, size: str, tail: int = 4000) -> DataFrame:
    """headings with until: where the next one begins; after the last, at most tail characters past its end."""
    return headings.withColumn("until", F.coalesce(F.lead(start).over(by(doc, start)), F.least(F.col(size), F.col(end) + tail)))


def monotonic(headings: DataFrame, doc: str, order: str, number: str) -> DataFrame:
    """Headings whose number isn't below an earlier one."""
    most = F.max(number).over(by(doc, order).rowsBetween(Window.unboundedPreceding, 0))
    return headings.withColumn("_m", most).where(F.col(number) == F.col("_m")).drop("_m")


def sequential_run(labels: DataFrame, doc: str, order: str, label: str) -> DataFrame:
    """The leading labels that count 1, 2, 3, ... without a gap."""
    w = by(doc, order)
    held = labels.withColumn("_ok", F.col(label) == F.row_number().over(w))
    return held.withColumn("_all", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_all").drop("_ok", "_all")


def increasing_prefix(labels: DataFrame, doc: str, order: str, label: str, least: int = 2) -> DataFrame:
    """The leading labels that strictly increase, of documents that hold at least `least`."""
    w = by(doc, order)
    held = labels.withColumn("_n", F.count("*").over(Window.partitionBy(doc))).withColumn("_ok", F.coalesce(F.col(label) > F.lag(label).over(w), F.lit(True)))
    return held.withColumn("_all", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_n") >= least) & F.col("_all")).drop("_n", "_ok", "_all")


def gaps(headings: DataFrame, doc: str, order: str, number: str) -> DataFrame:
    """doc and missing: numbers that one neighbour pair skips."""
    return headings.withColumn("_n", F.lead(number).over(by(doc, order))).where(F.col("_n") - F.col(number) == 2).select(doc, (F.col(number) + 1).alias("missing"))


def longest_run(labels: DataFrame, doc: str, order: str, number: str) -> DataFrame:
    """doc, first (place) and length of the longest run 1, 2, 3, ...; the later of equal ones. Runs of fewer than 3 don't count."""
    w = by(doc, order)
    begins = F.when(F.coalesce(F.lag(number).over(w) + 1 == F.col(number), F.lit(False)), 0).otherwise(1)
    runs = labels.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy(doc, "_run").agg(F.min(number).alias("_low"), F.count("*").alias("length"), F.min(order).alias("first")).where("_low = 1 AND length >= 3")
    return sizes.groupBy(doc).agg(F.max(F.struct("length", "first")).alias("m")).select(doc, F.col("m.first").alias("first"), F.col("m.length").alias("length"))


def unique_keys(sections: DataFrame, key: str, page: str, order: str) -> DataFrame:
    """sections with unique_key: a key met before gets its page, and a count from 2 on for more repeats on that page."""
    again = F.row_number().over(Window.partitionBy(key).orderBy(order))
    on_page = F.row_number().over(Window.partitionBy(key, page, F.col("_a") > 1).orderBy(order))
    tail = F.concat(F.lit("-p"), F.col(page).cast("string"), F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise(""))
    return sections.withColumn("_a", again).withColumn("_k", on_page).withColumn("unique_key", F.when(F.col("_a") == 1, F.col(key)).otherwise(F.concat(key, tail))).drop("_a", "_k")


#: What opens an explanation or a proviso.
EXPLANATION = r"(?<=\s)Explanation(?:\s?\d)?\.[—-]"
PROVISO = r"(?<=\s)Provided (?:that|further|also)[,:]?\s"


def proviso_split(text: Column) -> Column:
    """A struct (body, kind, child, at: the child's offset): text from the first Explanation on, else from the first proviso on, is a child of its own. Either follows white space."""
    parts = []
    for kind, marker in (("explanation", EXPLANATION), ("proviso", PROVISO)):
        at = F.regexp_instr(text, F.lit(marker))
        parts.append((at, F.struct(F.regexp_replace(F.substr(text, F.lit(1), at - 1), r"\s+\z", "").alias("body"), F.lit(kind).alias("kind"), F.substr(text, at).alias("child"), (at - 1).alias("at"))))
    none = F.struct(text.alias("body"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("int").alias("at"))
    return F.when(parts[0][0] > 1, parts[0][1]).when(parts[1][0] > 1, parts[1][1]).otherwise(none)


def longest_increasing(values: list[float]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, in O(n log n); of equal ones, the one that ends last, by the earliest members that lead there.

    For each length, the last members of subsequences of that length are kept in their order; their values never rise.
    """
    lasts: list[list[tuple[float, int]]] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(lasts, v, key=lambda row: row[-1][0])
        if k:
            row = lasts[k - 1]
            before[i] = row[bisect.bisect_right(row, -v, key=lambda x: -x[0])][1]
        if k == len(lasts):
            lasts.append([])
        lasts[k].append((v, i))
    out, at = [], lasts[-1][-1][1] if lasts else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def longest_increasing_rows(headings: DataFrame, doc: str, order: str, number: str) -> DataFrame:
    """Rows of each document's longest increasing subsequence. The chain of a document's headings is short and sequential: one array a document."""

    @F.pandas_udf("array<int>")
    def kept(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda v: longest_increasing([float(x) for x in v]))

    held = headings.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, number))).alias("_h"))
    chosen = held.select(doc, "_h", kept(F.transform("_h", lambda h: h[number].cast("double"))).alias("_k"))
    return chosen.select(doc, F.explode(F.transform("_k", lambda i: F.get("_h", i))).alias("_r")).select(doc, "_r.*")

"""Conversations, saved results and case files: visibility, context, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def visible(now: str, expires: str = "expires_at") -> Column:
    """Whether a row hasn't expired by an injected time."""
    return F.col(expires) > F.lit(now).cast("timestamp")


def purge(parents: DataFrame, children: list[tuple[DataFrame, str]], key: str, now: str) -> list[DataFrame]:
    """What remains: parents that haven't expired, then each (children, foreign key) of those that remain."""
    kept = parents.where(visible(now))
    return [kept, *(c.join(kept.select(F.col(key).alias(fk)), fk, "left_semi") for c, fk in children)]


def recent_context(messages: DataFrame, conversation: str, order: str, role: str, text: str, last: int = 6, each: int = 600, overall: int = 2400) -> DataFrame:
    """conversation and context: the newest messages in their order, each cut, and of the whole only the end."""
    newest = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order)))
    held = messages.withColumn("_n", newest).where(F.col("_n") <= last).select(conversation, F.struct(F.col(order).alias("o"), F.concat(role, F.lit(": "), F.substring(text, 1, each)).alias("t")).alias("m"))
    joined = held.groupBy(conversation).agg(F.array_sort(F.collect_list("m")).alias("m")).select(conversation, F.array_join(F.transform("m", lambda x: x["t"]), "\n").alias("c"))
    return joined.select(conversation, F.right("c", F.lit(overall)).alias("context"))


def append_positions(existing: DataFrame, new: DataFrame, case: str, order: str, item: str) -> DataFrame:
    """new items that the case doesn't hold yet, numbered after its last position."""
    fresh = new.join(existing, [case, item], "left_anti").dropDuplicates([case, item])
    last = existing.groupBy(case).agg(F.max("position").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(case).orderBy(order))
    return fresh.join(last, case, "left").select(case, item, (F.coalesce("_last", F.lit(0)) + nth).cast("int").alias("position"))


def is_permutation(wanted: str, current: str) -> Column:
    """Whether a new order holds each current item once."""
    return (F.size(F.array_distinct(wanted)) == F.size(wanted)) & (F.array_sort(wanted) == F.array_sort(current))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def integrity_of(results: DataFrame, audit: DataFrame, key: str, order: str) -> DataFrame:
    """results with integrity: ok, mismatch or missing, by the newest audit row of the request."""
    seen = latest(audit, key, order).select(key, F.col("digest").alias("_d"))
    return results.join(seen, key, "left").withColumn("integrity", F.when(F.col("_d").isNull(), "missing").when(F.col("_d") == F.col("digest"), "ok").otherwise("mismatch")).drop("_d")


def dossier(items: DataFrame, case: str, order: str, title: str, body: str) -> DataFrame:
    """case and markdown: the case's items under headings, in order; an item without a body is named as missing."""
    block = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.coalesce(body, F.lit("_missing_")))
    rows = items.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("m"))
    return rows.select(case, F.array_join(F.transform("m", lambda x: x["b"]), "\n\n").alias("markdown"))


def followups(own: str, templates: list[tuple[str, str]], n: int = 3) -> Column:
    """The first n suggestions of other intents."""
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in templates])
    return F.slice(F.transform(F.filter(every, lambda x: x["i"] != F.col(own)), lambda x: x["t"]), 1, n)


def expires_at(now: Column, days: int = 30) -> Column:
    """When a row written now expires."""
    return now + F.make_dt_interval(F.lit(days))


def touch(conversations: DataFrame, activity: DataFrame, key: str, days: int = 30) -> DataFrame:
    """conversations after new activity (key, title, at): new ones are added, known ones keep their title; either is updated and expires `days` later.

    conversations: key, title, updated_at, expires_at. The newest activity of a conversation counts, older than its last update it changes nothing.
    """
    old = conversations.select(key, "title", "updated_at", F.lit(0).alias("_new"))
    new = activity.select(key, "title", F.col("at").alias("updated_at"), F.lit(1).alias("_new"))
    merged = old.unionByName(new).groupBy(key).agg(F.min_by("title", F.struct("_new", "updated_at")).alias("title"), F.max("updated_at").alias("updated_at"))
    return merged.withColumn("expires_at", expires_at(F.col("updated_at"), days))


def append_messages(existing: DataFrame, new: DataFrame, conversation: str, order: str) -> DataFrame:
    """new messages with position: after the last one of their conversation, in their own order. Every message is kept, equal ones too."""
    last = existing.groupBy(conversation).agg(F.max("position").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(conversation).orderBy(order))
    return new.join(last, conversation, "left").withColumn("position", (F.coalesce("_last", F.lit(0)) + nth).cast("int")).drop("_last")


def with_results(messages: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """messages with result: that of an assistant's message, null if it is missing or has expired, and for all other roles. results: request_id, result, expires_at."""
    live = results.where(visible(now)).select(F.col("request_id").alias("_id"), "result")
    return messages.join(live, (messages["request_id"] == live["_id"]) & (messages["role"] == "assistant"), "left").drop("_id")


def case_items(refs: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """A case file's references with their results, of those that haven't expired; order by position, then created_at."""
    return refs.join(results.where(visible(now)).select("request_id", "result"), "request_id")


def remove_items(refs: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """References without the removed ones; positions stay."""
    return refs.join(removed.select(*keys).distinct(), keys, "left_anti")


def reorder(refs: DataFrame, wanted: DataFrame, case: str, item: str) -> DataFrame:
    """References in a wanted order (case, items): positions from 1, for cases whose order holds each item once; other cases stay as they are."""
    current = refs.groupBy(case).agg(F.collect_list(item).alias("_now"))
    good = wanted.join(current, case).where(is_permutation("items", "_now")).select(case, F.posexplode("items").alias("_at", item))
    return refs.join(good, [case, item], "left").withColumn("position", F.coalesce(F.col("_at") + 1, F.col("position")).cast("int")).drop("_at")


#: Rows that a task of a join between two large tables sorts at most, keys dealt evenly.
TASK_ROWS = 2_000_000


def unknown_requests(rows: DataFrame, requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose request exists, and the rejected ones with their reason.

    Both sides are dealt to as many tasks as their rows need, so a task's memory doesn't grow with them; repeated requests do no harm and stay.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(rows.count(), requests.count()) // TASK_ROWS))
    rows, known = rows.repartition(n, key), requests.select(key).repartition(n, key)
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti").withColumn("reason", F.lit("unknown_request"))


#: What a stored result of any type may hold, as far as summaries read it.
RESULT = (
    "type string, message string, reason string, dropped_claims int, summary string, category_label string, gauge string, score string, confidence struct<level:string,score:string>, "
    "sections array<struct<heading:string,jurisdiction:string,claims:array<struct<status:string,text:string>>,gaps:array<struct<text:string>>>>, requirements array<struct<text:string>>, abs_posture struct<summary:string>, "
    "per_section array<struct<section:string,risk:string,reasons:array<string>>>, what_would_help array<struct<text:string>>, checklist array<struct<title:string,authority:string,detail:string,required:boolean,exempt:boolean>>, "
    "normalized_ingredients array<struct<input:string,canonical_latin:string>>, matches array<struct<name:string,similarity:string>>, tkdl_query struct<text:string>, watchlist_hits array<struct<case:string,outcome:string>>"
)


def summary_lines(payload: Column) -> Column:
    """Lines that tell a stored result, by its type; what a type lacks gives no line. A result of another type is one line of its JSON; null for no result."""
    p = F.from_json(payload, RESULT)
    none = F.array().cast("array<string>")
    each = lambda rows, f: F.coalesce(F.transform(rows, f), none)
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    given = lambda c, line: F.when(c.isNotNull(), F.array(line)).otherwise(none)
    section = lambda s: F.concat(F.array(said(F.coalesce(s["heading"], s["jurisdiction"]), ":")), each(s["claims"], lambda c: said("  [", c["status"], "] ", c["text"])), each(s["gaps"], lambda g: said("  [gap] ", g["text"])))
    flat = lambda rows, f: F.coalesce(F.flatten(F.transform(rows, f)), none)
    status = lambda c: F.when(c["required"].isNull(), "unassessed").when(c["required"], "required").when(c["exempt"], "exempt").otherwise("n/a")
    lines = {
        "answer": F.concat(flat(p["sections"], section), F.when(p["dropped_claims"] > 0, F.array(said(p["dropped_claims"], " statement(s) removed: could not be verified."))).otherwise(none), given(p["confidence"], said("Confidence: ", p["confidence"]["level"], " (", p["confidence"]["score"], ")"))),
        "refusal": F.array(said("Reason: ", p["reason"]), said(p["message"])),
        "result": F.concat(F.array(said("Category: ", p["category_label"])), each(p["requirements"], lambda r: said("  Requirement: ", r["text"])), given(p["abs_posture"], said("  ABS posture: ", p["abs_posture"]["summary"]))),
        "patent_risk": F.concat(F.array(said("Overall risk indicator: ", p["gauge"], " (score ", p["score"], ")")), flat(p["per_section"], lambda s: F.concat(F.array(said("  s.", s["section"], ": ", s["risk"])), each(s["reasons"], lambda r: said("    - ", r)))), each(p["what_would_help"], lambda h: said("  What would help: ", h["text"]))),
        "abs": F.concat(F.array(said(p["summary"])), flat(p["checklist"], lambda c: F.array(said("  [", status(c), "] ", c["title"], " (authority: ", c["authority"], ")"), said("    ", c["detail"])))),
        "tk_radar": F.concat(F.array(F.lit("Normalised ingredients:")), each(p["normalized_ingredients"], lambda i: said("  ", i["input"], " -> ", i["canonical_latin"])), F.array(F.lit("Closest classical matches:")), each(p["matches"], lambda m: said("  ", m["name"], " (similarity ", m["similarity"], ")")), given(p["tkdl_query"], said("TKDL query pack: ", p["tkdl_query"]["text"])), each(p["watchlist_hits"], lambda w: said("Watchlist: ", w["case"], " — ", w["outcome"]))),
    }
    out = F.when(payload.isNull(), F.lit(None).cast("array<string>"))
    for kind, rows in lines.items():
        out = out.when(p["type"] == kind, rows)
    return out.otherwise(F.array(payload))


def dossier_items(requested: DataFrame, results: DataFrame) -> DataFrame:
    """requested (case, position, request_id) with kind and lines: of the stored result, or the kind missing and a note, so that no requested item is left out."""
    p = F.coalesce(F.get_json_object("result", "$.type"), F.lit("unknown"))
    joined = requested.join(results.select("request_id", "result"), "request_id", "left")
    return joined.withColumn("kind", F.when(F.col("result").isNull(), "missing").otherwise(p)).withColumn("lines", F.coalesce(summary_lines(F.col("result")), F.array(F.concat(F.lit("No stored result for request_id="), F.col("request_id").cast("string"))))).drop("result")

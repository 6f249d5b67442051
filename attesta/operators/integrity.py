"""Tamper evidence: hash chains, Merkle roots and proofs, receipts, change detection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions.payload import canonical_json, canonical_result
from attesta.functions.text import receipt_id
from attesta.session import shared_dir

GENESIS = "0" * 64
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def pair_hash(left: Column, right: Column) -> Column:
    """Hash of two hex digests' bytes, one after the other."""
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def chain(entries: DataFrame, key: str, seq: str, payload: str) -> DataFrame:
    """key, seq, prev_hash and entry_hash: each entry hashes the one before it and its own payload, a chain for each key.

    A chain is sequential by nature, so a key's entries stay in one task; they stream through it in their order, and only the
    last hash is kept. A null payload hashes like an empty one; entries with a null key are a chain of their own.
    """
    return append_chain(entries, None, key, seq, payload).drop("place")


def append_chain(entries: DataFrame, heads: DataFrame | None, key: str, seq: str, payload: str) -> DataFrame:
    """key, seq, place (from 0), prev_hash and entry_hash of new entries, as continuations of stored chains: only the new entries are hashed.

    heads: key, seq, place and entry_hash of each chain's last entry (chain_heads); a head travels to its key's task as a row of its own. A key
    without a head starts a chain. An entry that isn't after its chain's head in seq is an error, as it would change what is stored.
    """
    rows = entries.select(F.col(key).alias("_k"), F.col(seq).cast("bigint").alias("_s"), F.coalesce(F.col(payload), F.lit("")).alias("_p"), F.lit(None).cast("bigint").alias("_n"))
    if heads is not None:
        rows = rows.unionByName(heads.select(F.col(key).alias("_k"), F.col(seq).cast("bigint").alias("_s"), F.col("entry_hash").alias("_p"), F.col("place").cast("bigint").alias("_n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hash_, place, after_seq = object(), GENESIS, 0, None
        for batch in batches:
            keep, places, before, after = [], [], [], []
            for k, s, text, n in zip(*(batch[c].to_pylist() for c in ("_k", "_s", "_p", "_n")), strict=True):
                if k != last:
                    last, hash_, place, after_seq = k, GENESIS, 0, None
                keep.append(n is None)
                if n is not None:
                    hash_, place, after_seq = text, n + 1, s
                    continue
                if after_seq is not None and (s is None or s <= after_seq):
                    raise ValueError(f"entry {s} of chain {k} is not after its head {after_seq}")
                places.append(place)
                before.append(hash_)
                hash_, place = hashlib.sha256((hash_ + text).encode()).hexdigest(), place + 1
                after.append(hash_)
            new = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([new["_k"], new["_s"], pa.array(places, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], ["_k", "_s", "place", "prev_hash", "entry_hash"])

    kind = entries.schema[key].dataType.simpleString()
    linked = rows.repartition("_k").sortWithinPartitions("_k", F.col("_n").isNull(), "_s", "_p").mapInArrow(run, f"_k {kind}, _s bigint, place bigint, prev_hash string, entry_hash string")
    return linked.select(F.col("_k").alias(key), F.col("_s").alias(seq), "place", "prev_hash", "entry_hash")


def chain_heads(linked: DataFrame, heads: DataFrame | None, key: str, seq: str) -> DataFrame:
    """key, seq, place and entry_hash of each chain's last entry after new entries (append_chain) came to the stored heads."""
    rows = linked.select(key, seq, "place", "entry_hash")
    rows = rows if heads is None else rows.unionByName(heads.select(key, seq, "place", "entry_hash"))
    last = rows.groupBy(key).agg(F.max_by(F.struct(seq, "place", "entry_hash"), "place").alias("_l"))
    return last.select(key, f"_l.{seq}", "_l.place", "_l.entry_hash")


def chain_breaks(chained: DataFrame, key: str, seq: str, payload: str) -> DataFrame:
    """Entries whose prev_hash isn't the hash before, or whose own hash is wrong; checked in parallel, no fold."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(key).orderBy(seq)), F.lit(GENESIS))
    checked = chained.withColumn("_b", before).where((F.col("prev_hash") != F.col("_b")) | (F.col("entry_hash") != sha(F.concat("prev_hash", payload))))
    return checked.drop("_b")


def numbered(rows: DataFrame, key: str, order: str, name: str = "i") -> DataFrame:
    """rows with their place from 0 among those of their key, in the order of a column.

    Rows are dealt to tasks by ranges of (key, order) and numbered inside each range, on top of the sizes of the ranges before:
    no task holds all rows of a key.
    """
    shared_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1
    return ranged.withColumn("_at", inside).join(sizes, [key, "_range"]).withColumn(name, (F.col("_base") + F.col("_at")).cast("bigint")).drop("_range", "_at", "_base")


def _level(nodes: DataFrame) -> DataFrame:
    """The next level of a tree (tree, i, hash): neighbours are hashed together, an odd one is carried up."""
    both = nodes.groupBy("tree", F.floor(F.col("i") / 2).cast("bigint").alias("i")).agg(F.min_by("hash", "i").alias("l"), F.max_by("hash", "i").alias("r"), F.count("*").alias("n"))
    return both.select("tree", "i", F.when(F.col("n") == 1, F.col("l")).otherwise(pair_hash(F.col("l"), F.col("r"))).alias("hash"))


def _levels(level: DataFrame) -> list[DataFrame]:
    levels = [level]
    most = level.agg(F.max("i")).first()[0] or 0
    while most > 0:
        level = _level(level).checkpoint()
        levels.append(level)
        most //= 2
    return levels


def merkle_levels(leaves: DataFrame, tree: str, order: str, leaf: str) -> list[DataFrame]:
    """Levels (tree, i, hash) from the leaves to the roots. Each level halves the rows; levels are checkpointed, as the next ones use them twice."""
    rows = leaves.select(F.col(tree).alias("tree"), F.col(order).alias("o"), F.col(leaf).alias("hash"))
    return _levels(numbered(rows, "tree", "o").select("tree", "i", "hash").checkpoint())


def merkle_roots(leaves: DataFrame, tree: str, order: str, leaf: str) -> DataFrame:
    """tree and root. Trees of one key are reduced level by level, all trees at once."""
    return merkle_levels(leaves, tree, order, leaf)[-1].select(F.col("tree").alias(tree), F.col("hash").alias("root"))


def merkle_proofs(leaves: DataFrame, tree: str, order: str, leaf: str, keep: list[str] | None = None) -> DataFrame:
    """tree, i, leaf (and, if asked for, the order column by its name) and proof: an array of (level, sibling, left), left if the sibling stands left. A carried node has no step."""
    numbers = numbered(leaves.select(F.col(tree).alias("tree"), F.col(order).alias("o"), F.col(leaf).alias("hash")), "tree", "o").checkpoint()
    levels = _levels(numbers.select("tree", "i", "hash"))
    own = numbers.select("tree", "i", F.col("hash").alias("leaf"), *([F.col("o").alias(order)] if keep else []))
    steps = None
    for k, level in enumerate(levels[:-1]):
        at = own.select("tree", "i", F.floor(F.col("i") / 2**k).cast("bigint").alias("at")).withColumn("other", F.when(F.col("at") % 2 == 0, F.col("at") + 1).otherwise(F.col("at") - 1))
        step = at.join(level.select("tree", F.col("i").alias("other"), F.col("hash").alias("sibling")), ["tree", "other"]).select("tree", "i", F.struct(F.lit(k).alias("level"), "sibling", (F.col("other") < F.col("at")).alias("left")).alias("s"))
        steps = step if steps is None else steps.unionByName(step)
    if steps is None:
        return own.withColumn("proof", F.array().cast("array<struct<level:int,sibling:string,left:boolean>>"))
    grouped = steps.groupBy("tree", "i").agg(F.array_sort(F.collect_list("s")).alias("proof"))
    return own.join(grouped, ["tree", "i"], "left").withColumn("proof", F.coalesce("proof", F.array().cast("array<struct<level:int,sibling:string,left:boolean>>")))


def append_merkle(leaves: DataFrame, frontier: DataFrame | None, tree: str, order: str, leaf: str) -> DataFrame:
    """The frontier (tree, level, i, hash) of trees after new leaves came to the stored frontier: the roots of the full subtrees, one for each bit of
    the number of leaves.

    Only new leaves and log n stored nodes of each tree are hashed: level by level, new nodes meet the stored node of their level, pairs go up, and what is left
    without a partner is the frontier there. Within a batch, leaves stand in the order of a column; a later batch stands after those before. Leaves
    whose tree is null belong to no tree. A tree without new leaves keeps its frontier.
    """
    rows = leaves.where(F.col(tree).isNotNull()).select(F.col(tree).alias("tree"), F.col(order).alias("o"), F.col(leaf).alias("hash"))
    new = numbered(rows, "tree", "o").select("tree", "i", "hash")
    if frontier is None:
        old = new.sparkSession.createDataFrame([], new.schema).select("tree", F.lit(0).alias("level"), "i", "hash")
    else:
        old = frontier.select(F.col(tree).alias("tree"), F.col("level").cast("int").alias("level"), "i", "hash")
        sizes = old.groupBy("tree").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("_size"))
        new = new.join(sizes, "tree", "left").select("tree", (F.col("i") + F.coalesce("_size", F.lit(0))).alias("i"), "hash")
    nodes, left, level = new.checkpoint(), [], 0
    top = old.agg(F.max("level")).first()[0]
    most = nodes.agg(F.max("i")).first()[0]
    while (most is not None and most >> level) or (top is not None and level <= top) or (level == 0 and most is not None):
        met = nodes.unionByName(old.where(F.col("level") == level).select("tree", "i", "hash"))
        pairs = met.groupBy("tree", F.floor(F.col("i") / 2).cast("bigint").alias("up")).agg(F.min_by("hash", "i").alias("l"), F.max_by("hash", "i").alias("r"), F.min("i").alias("i"), F.count("*").alias("n")).checkpoint()
        left.append(pairs.where("n = 1").select("tree", F.lit(level).alias("level"), "i", F.col("l").alias("hash")))
        nodes = pairs.where("n = 2").select("tree", F.col("up").alias("i"), pair_hash(F.col("l"), F.col("r")).alias("hash"))
        level += 1
    left.append(nodes.select("tree", F.lit(level).alias("level"), "i", "hash"))
    return reduce(DataFrame.unionByName, left).withColumnRenamed("tree", tree).checkpoint()


def frontier_roots(frontier: DataFrame, tree: str) -> DataFrame:
    """tree and root of stored frontiers: their nodes (one a bit of the tree's size) are hashed from the smallest subtree up."""
    peaks = F.array_sort(F.collect_list(F.struct("level", "hash")))
    rows = frontier.groupBy(tree).agg(peaks.alias("_p"))
    return rows.select(tree, F.aggregate(F.slice("_p", 2, F.size("_p")), F.element_at("_p", 1)["hash"], lambda h, p: pair_hash(p["hash"], h)).alias("root"))


def proof_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.when(s["left"], pair_hash(s["sibling"], h)).otherwise(pair_hash(h, s["sibling"])))


def receipt_check(spans: DataFrame, chunks: DataFrame, chunk: str, digest: str, text: str) -> DataFrame:
    """spans with in_corpus and text_valid: whether the chunk exists and its text still has the digest."""
    now = chunks.select(F.col(chunk).alias("_c"), sha(F.col(text)).alias("_d"))
    return spans.join(now, F.col(chunk) == F.col("_c"), "left").withColumn("in_corpus", F.col("_c").isNotNull()).withColumn("text_valid", F.coalesce(F.col("_d") == F.col(digest), F.lit(False))).drop("_c", "_d")


def audit_entries(results: DataFrame) -> DataFrame:
    """results with entry (canonical JSON of what the chain binds) and result_hash.

    results: request_id, corpus_version, query_hash, spans (array of evidence_id, chunk_id, sha256), model_ids (struct), prompt_version,
    result and request (JSON texts, request may be null), ts. Only hashes of result and request enter the chain.
    """
    hashed = lambda c: F.when(F.col(c).isNotNull(), sha(canonical_json(F.col(c))))
    named = results.withColumn("result_hash", hashed("result")).withColumn("_request", hashed("request"))
    entry = F.struct(
        F.transform("spans", lambda x: x["sha256"]).alias("chunk_hashes"), "corpus_version", "model_ids", "prompt_version", "query_hash", "request_id", F.col("_request").alias("request_payload_hash"), "result_hash",
        F.get_json_object("result", "$.receipt_id").alias("result_receipt_field"), F.transform("spans", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["evidence_id"].alias("evidence_id"), x["sha256"].alias("sha256"))).alias("spans"), "ts")
    return named.withColumn("entry", canonical_json(F.to_json(entry, {"ignoreNullFields": "false"}))).drop("_request")


def build_receipts(results: DataFrame, log: str, seq: str, heads: DataFrame | None = None) -> DataFrame:
    """results with entry, result_hash, place, prev_hash, entry_hash and receipt_id; entries of one log are one chain, ordered by seq, which goes on from stored heads."""
    entries = audit_entries(results)
    linked = append_chain(entries, heads, log, seq, "entry")
    return entries.join(linked, [log, seq]).withColumn("receipt_id", receipt_id(F.col(seq)))


def verify_receipts(receipts: DataFrame, log: str, seq: str, chunks: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whether each receipt's chain is whole up to it (log, seq, chain_valid), and its spans with in_corpus and proof_valid.

    chunks: corpus_version, chunk_id, text and sha256 (the leaf as it was stored); roots: corpus_version, root. A span's proof is led
    from the hash of the text as it is now, so a changed text fails even where the stored leaf is untouched.
    """
    entry_ok = F.col("entry_hash") == sha(F.concat("prev_hash", "entry"))
    link_ok = F.col("prev_hash") == F.coalesce(F.lag("entry_hash").over(Window.partitionBy(log).orderBy(seq)), F.lit(GENESIS))
    sofar = Window.partitionBy(log).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    chained = receipts.withColumn("_ok", entry_ok & link_ok).select(log, seq, F.min("_ok").over(sofar).alias("chain_valid"))
    proofs = merkle_proofs(chunks, "corpus_version", "chunk_id", "sha256", keep=["chunk_id"]).join(chunks.select(F.col("corpus_version").alias("tree"), "chunk_id", sha(F.col("text")).alias("now")), ["tree", "chunk_id"]).join(roots.select(F.col("corpus_version").alias("tree"), "root"), "tree")
    valid = proofs.select(F.col("tree").alias("corpus_version"), "chunk_id", F.col("now"), (proof_root(F.col("now"), F.col("proof")) == F.col("root")).alias("valid"))
    spans = receipts.select(log, seq, "corpus_version", F.explode("spans").alias("s")).select(log, seq, "corpus_version", "s.evidence_id", "s.chunk_id", "s.sha256")
    met = spans.join(valid, ["corpus_version", "chunk_id"], "left")
    return chained, met.select(log, seq, "evidence_id", F.coalesce("now", "sha256").alias("sha256"), F.col("now").isNotNull().alias("in_corpus"), F.coalesce("valid", F.lit(False)).alias("proof_valid"))


def result_integrity(results: DataFrame, receipts: DataFrame) -> DataFrame:
    """request_id and integrity (ok, mismatch, missing): the stored result, with the receipt field that it had when it was hashed, hashes to what the chain holds.

    results: request_id, result (JSON). Receipts bring result_hash and entry; the newest receipt of a request counts.
    """
    newest = receipts.groupBy("request_id").agg(F.max_by("result_hash", "seq").alias("_h"), F.max_by("entry", "seq").alias("_e"))
    restored = canonical_result(F.col("result"), F.get_json_object("_e", "$.result_receipt_field"))
    return results.join(newest, "request_id", "left").select("request_id", F.when(F.col("_h").isNull(), "missing").when(sha(restored) == F.col("_h"), "ok").otherwise("mismatch").alias("integrity"))


def review_root(rows: DataFrame, group: str, key: str, digest: str, located: list[str]) -> DataFrame:
    """group and root: a Merkle root over each row's key, text digest and the hash of what locates it (columns as canonical JSON)."""
    named = F.to_json(F.struct(*sorted(located)), {"ignoreNullFields": "false"})
    leaf = sha(F.concat_ws("|", F.col(key).cast("string"), F.col(digest), sha(named)))
    return merkle_roots(rows.withColumn("_leaf", leaf), group, key, "_leaf")


def set_digest(rows: DataFrame, key: str, value: str, buckets: int = 256) -> DataFrame:
    """key and digest: a hash of the set of a key's values (repeats count), whatever their order. Values are hashed by buckets first, then the buckets'
    digests, so that no row holds all values of a key."""
    parts = rows.groupBy(key, F.pmod(F.xxhash64(value), F.lit(buckets)).alias("_b")).agg(sha(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), ",")).alias("_d"))
    return parts.groupBy(key).agg(sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: F.concat_ws(":", x["_b"].cast("string"), x["_d"])), ",")).alias("digest"))


def changes(pinned: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """key and status (added, removed, check_failed, changed, unchanged) of sources with digests; a null digest of a fetched one is a failed check."""
    p, f = pinned.select(key, F.col("digest").alias("_p"), F.lit(True).alias("_in_p")), fetched.select(key, F.col("digest").alias("_f"), F.lit(True).alias("_in_f"))
    status = F.when(F.col("_in_f").isNull(), "removed").when(F.col("_f").isNull(), "check_failed").when(F.col("_in_p").isNull(), "added").when(F.col("_p").eqNullSafe(F.col("_f")), "unchanged").otherwise("changed")
    return p.join(f, key, "full_outer").select(key, status.alias("status"))


def promotion_failures(checks: DataFrame, minimum_recall: float = 0.80) -> DataFrame:
    """version and failed: every check that keeps a version from going live.

    checks: version, status, reviewer, approved_hash, report_hash, issues, recall, leaks, root, stored_root, golden, stored_golden,
    manifest, stored_manifest, changed_files. Hashes must be equal and present.
    """
    differ = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    failed = F.array(
        F.when(F.col("status") != "staged", "not_staged"), F.when((F.trim(F.coalesce("reviewer", F.lit(""))) == "") | differ("approved_hash", "report_hash"), "approval"), F.when(F.col("issues") > 0, "issues"),
        F.when(F.coalesce(F.col("recall") < minimum_recall, F.lit(True)), "recall"), F.when(F.col("leaks") > 0, "leaks"), F.when(differ("root", "stored_root"), "root"), F.when(differ("golden", "stored_golden"), "golden"),
        F.when(differ("manifest", "stored_manifest"), "manifest"), F.when(F.col("changed_files") > 0, "files"),
    )
    return checks.select("version", F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("failed"))


def promote(versions: DataFrame, failures: DataFrame, version: str) -> DataFrame:
    """versions (version, status) after a promotion: the staged version goes live and the live one retires; nothing changes while a check fails."""
    blocked = failures.where(F.col("version") == version).limit(1).count() > 0
    staged = versions.where((F.col("version") == version) & (F.col("status") == "staged")).limit(1).count() > 0
    if blocked or not staged:
        return versions
    return versions.withColumn("status", F.when(F.col("version") == version, "live").when(F.col("status") == "live", "retired").otherwise(F.col("status")))


def chunk_invariants(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """chunks with sha_valid and offset_valid: the text has its digest, and is what the document's text holds from char_start to char_end."""
    full = documents.select(key, F.col("full_text").alias("_full"))
    part = F.substr("_full", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    inside = (F.col("char_start") >= 0) & (F.col("char_end") <= F.length("_full"))
    return chunks.join(full, key, "left").withColumn("sha_valid", F.coalesce(sha(F.col("text")) == F.col("sha256"), F.lit(False))).withColumn("offset_valid", F.coalesce(inside & (part == F.col("text")), F.lit(False))).drop("_full")

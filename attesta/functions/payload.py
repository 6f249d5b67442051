"""Stored payloads: scrubbing nested values, reading and checking JSON, canonical JSON, summaries and bounds."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from attesta.functions.text import scrub_pii

#: Fields that the server owns, which stay as they are.
OWNED = ("evidence", "nearest_sources")


def scrubbed(value: Column, kind: DataType) -> Column:
    """A nested value with all its strings scrubbed, whatever the depth; owned fields and map keys stay."""
    if isinstance(kind, StringType):
        return scrub_pii(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: scrubbed(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: F.when(k.isin(*OWNED), v).otherwise(scrubbed(v, kind.valueType)))
    if isinstance(kind, StructType):
        fields = [(value[f.name] if f.name in OWNED else scrubbed(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def scrub_payload(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the named columns scrubbed by their own types."""
    return df.withColumns({c: scrubbed(F.col(c), df.schema[c].dataType) for c in columns})


def field_at(payload: Column, path: str, kind: str = "string") -> Column:
    """A value of a JSON text by its dotted path; null where it is absent or of another kind."""
    return F.get_json_object(payload, "$." + path).try_cast(kind)


def unknown_keys(payload: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON object that its schema doesn't allow; null for what is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, allowed))))


def valid_payload(payload: Column, schema: str, allowed: list[str], required: list[str]) -> Column:
    """Whether a JSON text parses by a schema, has all required fields and no others than allowed."""
    parsed = F.from_json(payload, schema, {"mode": "PERMISSIVE"})
    present = [parsed[r].isNotNull() for r in required]
    held = F.size(unknown_keys(payload, allowed)) == 0
    for p in present:
        held = held & p
    return F.coalesce(held, F.lit(False))


def within_bounds(statement: Column, evidence_ids: Column) -> Column:
    """Whether a claim has a statement of 1 to 1,000 characters and 1 to 12 evidence ids."""
    return F.coalesce(F.length(statement).between(1, 1000) & F.size(evidence_ids).between(1, 12), F.lit(False))


@F.arrow_udf(StringType())
def canonical_json(texts: pa.Array) -> pa.Array:
    """JSON with sorted keys, without blanks, in ASCII; null for what doesn't parse."""
    out = []
    for t in texts.to_pylist():
        try:
            out.append(None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def canonical_result(texts: pa.Array, receipts: pa.Array) -> pa.Array:
    """Canonical JSON of results with their receipt_id set to another one, or without any for null; null for what is no object."""
    out = []
    for t, receipt in zip(texts.to_pylist(), receipts.to_pylist(), strict=True):
        try:
            value = None if t is None else json.loads(t)
        except ValueError:
            value = None
        if isinstance(value, dict):
            value.pop("receipt_id", None)
            if receipt is not None:
                value["receipt_id"] = receipt
            out.append(json.dumps(value, sort_keys=True, separators=(",", ":")))
        else:
            out.append(None)
    return pa.array(out, pa.string())


def result_summary(payload: Column) -> Column:
    """One text for a stored result: its claims' texts by lines, else message, category label or summary, else its type, else Result."""
    parsed = F.from_json(payload, "struct<sections:array<struct<claims:array<struct<text:string>>>>,message:string,category_label:string,summary:string,type:string>")
    claims = F.flatten(F.transform(F.coalesce(parsed["sections"], F.array()), lambda s: F.coalesce(s["claims"], F.array())))
    lines = F.array_join(F.transform(claims, lambda c: c["text"]), "\n")
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(lines), given(parsed["message"]), given(parsed["category_label"]), given(parsed["summary"]), parsed["type"], F.lit("Result"))

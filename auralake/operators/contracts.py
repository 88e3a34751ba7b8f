"""Validation of JSON against a schema document, compiled to column expressions over VARIANT values.

Of JSON schema it knows type (one or several), required, properties, additionalProperties false, items, minItems, maxItems,
minimum, const and enum. Each issue has a path like `$[3].metrics[0].name` and a message. No Python runs, and a schema adds
no shuffle; a text that is no JSON has one issue at its root.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUES = "array<struct<path:string,message:string>>"

_TEXT, _COUNT, _AMOUNT = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0}
_MAYBE_TEXT = {"type": ["string", "null"]}
_TEXTS = {"type": "array", "items": _TEXT}

METRIC = {"type": "object", "required": ["name", "value", "unit", "group"], "properties": {"name": _TEXT, "value": {"type": ["number", "string", "boolean", "null"]}, "unit": _TEXT, "group": _TEXT, "description": _TEXT, "warning": _MAYBE_TEXT, "higher_is_better": {"type": ["boolean", "null"]}, "reference_range": {"type": ["array", "null"], "items": {"type": "number"}, "minItems": 2, "maxItems": 2}}}
LABEL = {"type": "object", "required": ["id", "severity", "confidence"], "properties": {"id": _TEXT, "severity": {"type": "string", "enum": ["info", "warn", "fail"]}, "confidence": {"type": ["number", "null"]}, "evidence": _TEXT, "metrics": {"type": ["array", "object"]}}}
INSIGHTS = {"type": "object", "properties": {"version": _TEXT, "fingerprint": {"type": ["object", "string", "null"]}, "defect_labels": {"type": "array", "items": LABEL}, "repair_suggestions": _TEXTS}}
#: One report row; a report is a list of them.
REPORT_ROW = {"type": "object", "required": ["file", "duration_s", "sample_rate", "channels", "metrics"], "properties": {"file": _TEXT, "source_file": _MAYBE_TEXT, "duration_s": _AMOUNT, "sample_rate": _COUNT, "channels": _COUNT, "error": _MAYBE_TEXT, "content_type": _MAYBE_TEXT, "segment_index": {"type": ["integer", "null"]}, "notes": _TEXTS, "schema_version": _MAYBE_TEXT, "metrics": {"type": "array", "items": METRIC}, "insights": {"type": ["object", "null"], "properties": INSIGHTS["properties"]}}}
REPORT = {"type": "array", "items": REPORT_ROW}

#: How VARIANT names the types of a schema.
KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN$", "null": "^VOID$"}


def _issue(path: Column, message: str | Column) -> Column:
    return F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _only(condition: Column, path: Column, message: str) -> Column:
    none = F.array().cast(ISSUES)
    return F.when(condition, F.array(_issue(path, message))).otherwise(none)


def _joined(parts: list[Column]) -> Column:
    return F.concat(*[p.cast(ISSUES) for p in parts]) if parts else F.array().cast(ISSUES)


def issues_of(value: Column, schema: dict, path: Column) -> Column:
    """array<struct<path, message>> of a VARIANT value that is there."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    kind = F.schema_of_variant(value)
    fits = reduce(lambda a, b: a | b, [kind.rlike(KINDS[k]) for k in kinds]) if kinds else F.lit(True)
    inner: list[Column] = []
    if "object" in kinds or schema.get("properties"):
        inner.append(F.when(kind.rlike(KINDS["object"]), _of_object(value, schema, path)))
    if "array" in kinds or "items" in schema:
        inner.append(F.when(kind.rlike(KINDS["array"]), _of_array(value, schema, path)))
    number = F.when(kind.rlike(KINDS["number"]), F.try_variant_get(value, "$", "double"))
    if "minimum" in schema:
        inner.append(_only(number < schema["minimum"], path, f"must be {schema['minimum']} or more"))
    allowed = [schema["const"]] if "const" in schema else schema.get("enum")
    if allowed is not None:
        inner.append(_only(~F.to_json(value).isin([json.dumps(a, ensure_ascii=False) for a in allowed]), path, f"must be {' or '.join(json.dumps(a, ensure_ascii=False) for a in allowed)}"))
    none = F.array().cast(ISSUES)
    return F.when(~fits, F.array(_issue(path, f"must be {' or '.join(kinds)}"))).otherwise(_joined([F.coalesce(i, none) for i in inner]))


def _of_object(value: Column, schema: dict, path: Column) -> Column:
    known = schema.get("properties", {})
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string, variant>"))
    parts = [_only(~F.array_contains(keys, k), F.concat(path, F.lit(f".{k}")), "required field is missing") for k in schema.get("required", [])]
    for k, sub in known.items():
        own = F.try_variant_get(value, f"$.{k}", "variant")
        parts.append(F.when(own.isNotNull(), issues_of(own, sub, F.concat(path, F.lit(f".{k}")))).otherwise(F.array().cast(ISSUES)))
    if schema.get("additionalProperties") is False:
        parts.append(F.transform(F.array_sort(F.filter(keys, lambda k: ~k.isin(list(known)))), lambda k: _issue(F.concat(path, F.lit("."), k), "unexpected field")))
    return _joined(parts)


def _of_array(value: Column, schema: dict, path: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    parts = []
    if "minItems" in schema:
        parts.append(_only(F.size(items) < schema["minItems"], path, f"must hold {schema['minItems']} items or more"))
    if "maxItems" in schema:
        parts.append(_only(F.size(items) > schema["maxItems"], path, f"must hold {schema['maxItems']} items or fewer"))
    if "items" in schema:
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        parts.append(F.flatten(F.transform(items, lambda v, i: issues_of(v, schema["items"], at(i)))))
    return _joined(parts)


def json_issues(texts: DataFrame, column: str, schema: dict, root: Column | None = None) -> DataFrame:
    """The other columns of texts with path and message, a row an issue; `root` is a row's path, `$` if none is given."""
    root = F.lit("$") if root is None else root
    others = [c for c in texts.columns if c != column]
    parsed = texts.select(*others, root.alias("_root"), F.try_parse_json(F.col(column).cast("string")).alias("_value"))
    found = F.when(F.col("_value").isNull(), F.array(_issue(F.col("_root"), "is no JSON"))).otherwise(issues_of(F.col("_value"), schema, F.col("_root")))
    return parsed.select(*others, F.inline(found))


def report_issues(spark, path: str) -> DataFrame:
    """path and message of what is wrong with a report file: one JSON list, or JSON lines whose numbers start from 0."""
    if path.lower().endswith((".jsonl", ".ndjson")):
        rows = spark.read.text(path).where("trim(value) != ''")
        from .ranking import global_row_number

        numbered = global_row_number(rows.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())), [F.asc("_at")], "_number")
        return json_issues(numbered.select("value", "_number"), "value", REPORT_ROW, F.concat(F.lit("$["), (F.col("_number") - 1).cast("string"), F.lit("]"))).select("path", "message")
    return json_issues(spark.read.text(path, wholetext=True).select("value"), "value", REPORT)

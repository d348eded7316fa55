"""Answers of language models as JSON: shapes checked by schema, canonical hashes.

The answers are derived from all events: their properties, types and values.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_shape
from ..functions import listing_copy as copy
from ..sources.tables import Tables
from .registry import query

_SCORE = {"type": "integer", "minimum": 0, "maximum": 100}
_LIST = {"type": "array", "items": {"type": "string"}}
#: Shape of a listing audit (fixed values).
AUDIT: dict[str, Any] = {
    "type": "object",
    "required": ["listing_id", "platform", "overall_score", "title_quality", "description_quality", "image_quality", "pricing_risk", "action_recommendation"],
    "properties": {
        "listing_id": {"type": "string"},
        "platform": {"type": "string", "enum": ["mercari", "rakuten", "amazon"]},
        "overall_score": _SCORE,
        "title_quality": {"type": "object", "required": ["score", "issues", "suggested_title"], "properties": {"score": _SCORE, "issues": _LIST, "suggested_title": {"type": "string"}}},
        "description_quality": {"type": "object", "required": ["score", "issues", "suggested_description"], "properties": {"score": _SCORE, "issues": _LIST, "suggested_description": {"type": "string"}}},
        "image_quality": {"type": "object", "required": ["score", "issues"], "properties": {"score": _SCORE, "issues": _LIST}},
        "pricing_risk": {"type": "object", "required": ["level", "reason"], "properties": {"level": {"type": "string", "enum": ["low", "medium", "high"]}, "reason": {"type": "string"}}},
        "action_recommendation": {
            "type": "object",
            "required": ["type", "priority", "reason"],
            "properties": {"type": {"type": "string", "enum": ["no_action", "rewrite", "manual_review", "price_check", "image_fix"]}, "priority": {"type": "string", "enum": ["low", "medium", "high"]}, "reason": {"type": "string"}},
        },
    },
}
_TEXT = {"type": "string", "pattern": "\\S"}
_LEVELS = ["low", "medium", "high", "critical"]
#: Shape of a visual review (fixed values).
REVIEW: dict[str, Any] = {
    "type": "object",
    "required": ["overall_score", "risk_level", "summary", "issues", "recommendations", "human_review_required", "confidence"],
    "properties": {
        "overall_score": {"type": "number", "minimum": 0, "maximum": 100},
        "risk_level": {"type": "string", "enum": _LEVELS},
        "summary": _TEXT,
        "issues": {"type": "array", "items": {"type": "object", "required": ["type", "severity", "evidence", "operator_note"], "properties": {"type": _TEXT, "severity": {"type": "string", "enum": _LEVELS}, "evidence": _TEXT, "operator_note": _TEXT}}},
        "recommendations": {
            "type": "array",
            "items": {"type": "object", "required": ["action_type", "priority", "reason"], "properties": {"action_type": {"type": "string", "enum": ["no_action", "rewrite", "image_fix", "price_check", "mapping_fix", "manual_review", "create_task"]}, "priority": {"type": "string", "enum": _LEVELS}, "reason": _TEXT}},
        },
        "human_review_required": {"type": "boolean"},
        "confidence": {"type": "number", "minimum": 0, "maximum": 1},
    },
}

#: An audit of each event as text; the same expression in both engines.
_AUDIT_TEXT = """CASE WHEN event_id % 17 = 0 THEN 'oops {' WHEN event_id % 19 = 0 THEN '[' || props || ']' ELSE
  '{"listing_id": ' || CASE WHEN event_id % 11 = 0 THEN CAST(event_id AS STRING) ELSE '"L' || CAST(event_id AS STRING) || '"' END
  || CASE event_type WHEN 'view' THEN ', "platform": "mercari"' WHEN 'click' THEN ', "platform": "rakuten"' WHEN 'purchase' THEN ', "platform": "amazon"' WHEN 'signup' THEN ', "platform": "shop"' ELSE '' END
  || ', "overall_score": ' || CASE WHEN k % 4 = 1 THEN CAST(k AS STRING) || '.5' WHEN k % 4 = 2 THEN CAST(k AS STRING) || '.0' WHEN k % 4 = 3 THEN CAST(k * 3 AS STRING) ELSE CAST(k AS STRING) END
  || ', "title_quality": ' || CASE WHEN k % 6 = 5 THEN 'null' ELSE '{"score": ' || CAST(k - 9 AS STRING) || ', "issues": ["short", ' || CASE WHEN k % 5 = 0 THEN props ELSE '"' || event_type || '"' END || ', 7]' || CASE WHEN k % 3 = 0 THEN '' ELSE ', "suggested_title": "t"' END || '}' END
  || ', "description_quality": {"issues": [], "suggested_description": "d", "score": "' || CAST(k AS STRING) || '"}'
  || CASE WHEN k % 9 = 0 THEN '' ELSE ', "image_quality": {"score": ' || CAST(k + 20 AS STRING) || ', "issues": ' || CASE WHEN k % 2 = 0 THEN '[]' ELSE '"none"' END || '}' END
  || ', "pricing_risk": {"reason": "r", "level": ' || CASE WHEN k < 30 THEN '"low"' WHEN k < 60 THEN '"HIGH"' ELSE 'true' END || '}'
  || ', "action_recommendation": {"type": "rewrite", "priority": "' || CASE WHEN k % 7 = 0 THEN 'urgent' ELSE 'low' END || '", "reason": ' || CASE WHEN k % 8 = 0 THEN 'null' ELSE '"x"' END || ', "extra": 1}}' END"""
_REVIEW_TEXT = """'{"overall_score": ' || CAST(k * 1.5 AS STRING) || ', "risk_level": "' || CASE WHEN k % 5 = 0 THEN 'none' ELSE 'high' END || '", "summary": "' || CASE WHEN k % 6 = 0 THEN '  ' ELSE event_type END || '"'
  || ', "issues": [{"type": "' || event_type || '", "severity": "low", "evidence": "e", "operator_note": "n"}, {"type": "", "severity": ' || CASE WHEN k % 3 = 0 THEN '"awful"' ELSE '3' END || ', "evidence": "e"}]'
  || CASE WHEN k % 4 = 0 THEN '' ELSE ', "recommendations": [{"action_type": "' || event_type || '", "priority": "low", "reason": "r"}, ' || props || ']' END
  || ', "human_review_required": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE '"yes"' END || ', "confidence": ' || CAST(k / 80.0 AS STRING) || '}'"""
#: Nested properties, keys in an order that the event's number chooses.
_NESTED_TEXT = """CASE WHEN event_id % 2 = 0 THEN '{"b": {"y": [1, {"q": null, "p": ' || props || '}], "x": "' || event_type || '"}, "a": ' || CAST(event_id AS STRING) || '.50}' ELSE '{ "a":' || CAST(event_id - 1 AS STRING) || '.5, "b":{"x":"' || event_type || '","y":[1.0,{"p":' || props || ',"q":null}]}}' END"""


def _sql(kind: str) -> str:
    return f"e AS (SELECT event_id, event_type, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), t AS (SELECT event_id, {kind} AS text FROM e), b AS (SELECT event_id, json_valid(text) AS valid, CASE WHEN json_valid(text) THEN text ELSE 'null' END AS body FROM t)"


def _of_score(name: str, more: str) -> str:
    """Oracle of an object with a score and a list of issues."""
    at = f"$.{name}"
    return f"""CASE WHEN t('{at}') IS NULL THEN ['{at}: required'] WHEN t('{at}') <> 'OBJECT' THEN ['{at}: expected object'] ELSE list_concat({_whole(at + '.score')}, list_concat(
    CASE WHEN t('{at}.issues') IS NULL THEN ['{at}.issues: required'] WHEN t('{at}.issues') <> 'ARRAY' THEN ['{at}.issues: expected array'] ELSE list_filter(list_transform(range(json_array_length(body, '{at}.issues')::BIGINT), lambda i: CASE WHEN json_type(body, '{at}.issues[' || i || ']') <> 'VARCHAR' THEN '{at}.issues[' || i || ']: expected string' END), lambda e: e IS NOT NULL) END, {more})) END"""


def _whole(at: str) -> str:
    return f"""CASE WHEN t('{at}') IS NULL THEN ['{at}: required'] WHEN t('{at}') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR x('{at}')::DOUBLE <> floor(x('{at}')::DOUBLE) THEN ['{at}: expected integer'] WHEN x('{at}')::DOUBLE < 0 THEN ['{at}: below 0'] WHEN x('{at}')::DOUBLE > 100 THEN ['{at}: above 100'] ELSE [] END"""


def _one_of(at: str, *known: str) -> str:
    enum = f"WHEN x('{at}') NOT IN ({', '.join(repr(k) for k in known)}) THEN ['{at}: not one of {', '.join(known)}']" if known else ""
    return f"CASE WHEN t('{at}') IS NULL THEN ['{at}: required'] WHEN t('{at}') <> 'VARCHAR' THEN ['{at}: expected string'] {enum} ELSE [] END"


def _oracle(parts: list[str], text: str) -> str:
    joined = "[]"
    for p in reversed(parts):
        joined = f"list_concat({p}, {joined})"
    expanded = joined.replace("t('", "json_type(body, '").replace("x('", "json_extract_string(body, '")
    return f"WITH {_sql(text)} SELECT event_id, CASE WHEN NOT valid THEN ['$: not JSON'] WHEN json_type(body) <> 'OBJECT' THEN ['$: expected object'] ELSE {expanded} END AS errors FROM b"


_AUDIT_PARTS = [
    _one_of("$.listing_id"),
    _one_of("$.platform", "mercari", "rakuten", "amazon"),
    _whole("$.overall_score"),
    _of_score("title_quality", _one_of("$.title_quality.suggested_title")),
    _of_score("description_quality", _one_of("$.description_quality.suggested_description")),
    _of_score("image_quality", "[]"),
    _one_of("$.pricing_risk.level", "low", "medium", "high"),
    _one_of("$.pricing_risk.reason"),
    _one_of("$.action_recommendation.type", "no_action", "rewrite", "manual_review", "price_check", "image_fix"),
    _one_of("$.action_recommendation.priority", "low", "medium", "high"),
    _one_of("$.action_recommendation.reason"),
]


def _said(at: str) -> str:
    return f"CASE WHEN t('{at}') IS NULL THEN ['{at}: required'] WHEN t('{at}') <> 'VARCHAR' THEN ['{at}: expected string'] WHEN NOT regexp_matches(x('{at}'), '\\S') THEN ['{at}: doesn''t match \\S'] ELSE [] END"


def _ranged(at: str, most: int) -> str:
    return f"CASE WHEN x('{at}')::DOUBLE < 0 THEN ['{at}: below 0'] WHEN x('{at}')::DOUBLE > {most} THEN ['{at}: above {most}'] ELSE [] END"


_REVIEW_PARTS = [
    _ranged("$.overall_score", 100),
    _one_of("$.risk_level", *_LEVELS),
    _said("$.summary"),
    *[p for i in range(2) for p in (_said(f"$.issues[{i}].type"), _one_of(f"$.issues[{i}].severity", *_LEVELS), _said(f"$.issues[{i}].evidence"), _said(f"$.issues[{i}].operator_note"))],
    "CASE WHEN t('$.recommendations') IS NULL THEN ['$.recommendations: required'] ELSE "
    + "list_concat("
    + _one_of("$.recommendations[0].action_type", *REVIEW["properties"]["recommendations"]["items"]["properties"]["action_type"]["enum"])
    + ", ['$.recommendations[1].action_type: required', '$.recommendations[1].priority: required', '$.recommendations[1].reason: required']) END",
    "CASE WHEN t('$.human_review_required') <> 'BOOLEAN' THEN ['$.human_review_required: expected boolean'] ELSE [] END",
    _ranged("$.confidence", 1),
]


def _bodies(t: Tables, text: str) -> DataFrame:
    e = t.events.select("event_id", "event_type", "props", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select("event_id", F.expr(text).alias("body"))


def _errors(t: Tables, text: str, schema: dict[str, Any]) -> DataFrame:
    body: Column = F.col("body")
    return _bodies(t, text).select("event_id", json_shape.shape_errors(body, schema).alias("errors"))


@query(_oracle(_AUDIT_PARTS, _AUDIT_TEXT))
def audit_shape_errors(t: Tables) -> DataFrame:
    """Audits of all events under the audit's schema."""
    return _errors(t, _AUDIT_TEXT, AUDIT)


@query(_oracle(_REVIEW_PARTS, _REVIEW_TEXT))
def review_shape_errors(t: Tables) -> DataFrame:
    """Visual reviews of all events under the review's schema, lists by their places."""
    return _errors(t, _REVIEW_TEXT, REVIEW)


@query("""WITH e AS (SELECT event_id - event_id % 2 AS pair, event_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
c AS (SELECT event_id, '{"a":' || pair || '.5,"b":{"x":"' || event_type || '","y":[1,{"p":{"k":' || k || '},"q":null}]}}' AS canonical FROM e) SELECT event_id, canonical, sha256(canonical) AS content_hash FROM c""")
def canonical_json_hashes(t: Tables) -> DataFrame:
    """Nested objects and arrays hash alike whatever the order of their keys."""
    body = _bodies(t, _NESTED_TEXT)
    return body.select("event_id", json_shape.canonical_json(F.col("body")).alias("canonical"), json_shape.json_hash(F.col("body")).alias("content_hash"))


@query("""WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN coalesce(text, '') || ' {"role": "' || role || '", "turn": ' || turn || '} so be it' WHEN 1 THEN '```json' || chr(10) || '{"role": "' || role || '", "turn": ' || turn || ', "more": {"a": [1]}}' || chr(10) || '```'
  WHEN 2 THEN '{"role": "' || role || '", "turn": ' || turn || '}{' || coalesce(text, '') ELSE coalesce(text, '') END AS answer FROM conversations),
f AS (SELECT *, trim(regexp_replace(regexp_replace(trim(answer, ' '), '(?i)^```(?:json)?[\\s\\x0B]*', ''), '```$', ''), ' ') AS t FROM a), g AS (SELECT *, regexp_extract(t, '(?s)\\{.*\\}') AS i FROM f),
b AS (SELECT conv_id, turn, CASE WHEN json_valid(t) AND t LIKE '{%' THEN t WHEN json_valid(i) AND i LIKE '{%' THEN i END AS body FROM g)
SELECT conv_id, turn, body IS NOT NULL AS is_object, json_extract_string(body, '$.role') AS role, CAST(json_extract_string(body, '$.turn') AS BIGINT) AS said_turn FROM b""")
def answers_in_turns(t: Tables) -> DataFrame:
    """The JSON object that a turn of a conversation holds, in a fence or between its words."""
    text, role, turn = F.coalesce("text", F.lit("")), F.col("role"), F.col("turn").cast("string")
    body = F.concat(F.lit('{"role": "'), role, F.lit('", "turn": '), turn)
    k = F.col("turn") % 4
    answer = F.when(k == 0, F.concat(text, F.lit(" "), body, F.lit("} so be it"))).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit(', "more": {"a": [1]}}\n```'))).when(k == 2, F.concat(body, F.lit("}{"), text)).otherwise(text)
    found = t.conversations.select("conv_id", "turn", copy.lenient_json(answer).alias("body"))
    return found.select("conv_id", "turn", F.col("body").isNotNull().alias("is_object"), F.get_json_object("body", "$.role").alias("role"), F.get_json_object("body", "$.turn").cast("long").alias("said_turn"))

"""Canonical JSON and schema faults on texts of every kind."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from stallwright.functions import json_shape
from stallwright.plans.answers import AUDIT


def shuffled(value, r):
    """The same value with the keys of every object in another order."""
    if isinstance(value, dict):
        keys = list(value)
        r.shuffle(keys)
        return {k: shuffled(value[k], r) for k in keys}
    return [shuffled(v, r) for v in value] if isinstance(value, list) else value


def test_key_order_at_any_depth_makes_no_difference(spark):
    value = {"z": [{"b": {"y": [[{"k": 1, "a": None}]], "x": "é\n\"q\""}, "a": True}, 1.25], "a": {"Z": 0, "a": -3, "é": 12345678901234567890}, "": {}}
    r = random.Random(0)
    texts = [(json.dumps(shuffled(value, r), indent=r.choice([None, 2]), ensure_ascii=r.choice([True, False])),) for _ in range(20)]
    expected = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    rows = spark.createDataFrame(texts, "t string").select(json_shape.canonical_json(F.col("t")), json_shape.json_hash(F.col("t"))).distinct().collect()
    assert [tuple(x) for x in rows] == [(expected, hashlib.sha256(expected.encode()).hexdigest())]


def test_canonical_forms_of_odd_texts(spark):
    rows = [(None, None), ("", None), ("{", None), ('{"a":1,"a":2}', None), ("1.50", "1.5"), ("2.0", "2"), ("[ ]", "[]"), ('"\\u001F\\\\u001F\\u000b"', '"\\u001f\\\\u001F\\u000b"'), ("null", "null")]
    got = spark.createDataFrame(rows, "t string, want string").select(json_shape.canonical_json(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def errors(spark, value, schema):
    text = value if isinstance(value, str) else json.dumps(value)
    return spark.createDataFrame([(text,)], "t string").select(json_shape.shape_errors(F.col("t"), schema)).first()[0]


def test_schema_faults_name_their_paths(spark):
    good = {
        "listing_id": "1", "platform": "amazon", "overall_score": 5.0, "title_quality": {"score": 0, "issues": [], "suggested_title": ""},
        "description_quality": {"score": 100, "issues": ["a"], "suggested_description": ""}, "image_quality": {"score": 1, "issues": []},
        "pricing_risk": {"level": "low", "reason": ""}, "action_recommendation": {"type": "rewrite", "priority": "low", "reason": "", "more": None}, "other": [1],
    }
    assert errors(spark, good, AUDIT) == []
    bad = good | {"platform": "x", "overall_score": 101, "title_quality": {"score": 1.5, "issues": ["a", 2, None]}, "image_quality": []}
    del bad["listing_id"]
    assert errors(spark, bad, AUDIT) == [
        "$.listing_id: required", "$.platform: not one of mercari, rakuten, amazon", "$.overall_score: above 100", "$.title_quality.score: expected integer", "$.title_quality.issues[1]: expected string",
        "$.title_quality.issues[2]: expected string", "$.title_quality.suggested_title: required", "$.image_quality: expected object",
    ]
    assert errors(spark, "nope", AUDIT) == ["$: not JSON"]
    assert errors(spark, "[]", AUDIT) == ["$: expected object"]
    nested = {"type": "array", "items": {"type": "array", "items": {"type": "string", "minLength": 2, "maxLength": 3}}}
    assert errors(spark, [["ab"], ["a", "abcd"], "x"], nested) == ["$[1][0]: shorter than 2", "$[1][1]: longer than 3", "$[2]: expected array"]
    assert errors(spark, {"a": None, "b": 1}, {"type": "object", "properties": {"a": {"type": "null"}, "b": {}}}) == []


def test_a_schema_that_is_not_understood_is_refused():
    with pytest.raises(ValueError, match="oneOf"):
        json_shape.shape_errors(F.lit("1"), {"oneOf": []})

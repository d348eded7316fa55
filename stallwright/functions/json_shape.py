"""JSON texts in canonical form, and their shape checked against a JSON Schema.

Both work on Spark's VARIANT values, in the JVM: an object's fields are kept sorted by
name at every depth, so writing a parsed text again sorts all keys; and a schema is
compiled to one expression that names each fault by its path.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<string>"
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
#: What a schema says without asking anything of a value.
_NOTES = {"$schema", "$id", "title", "description", "examples", "default"}
_KNOWN = {"type", "required", "properties", "items", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern"}
#: Control characters whose escapes have letters; they are written in lower case.
_CONTROLS = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def canonical_json(c: Column) -> Column:
    """A JSON text without white space, keys sorted by name at every depth, numbers without
    trailing zeros of their fractions; null for null, for what is no JSON, and for an
    object that has a key twice. Numbers in exponent notation keep the form of a double."""
    out = F.to_json(F.try_parse_json(c))
    plain = out
    for code in _CONTROLS:
        plain = F.regexp_replace(plain, f"((?:^|[^\\\\])(?:\\\\\\\\)*)\\\\u00{code}", f"$1\\\\u00{code.lower()}")
    return F.when(F.contains(out, F.lit("\\u00")), plain).otherwise(out)


def json_hash(c: Column) -> Column:
    """SHA-256 of the canonical form: alike for objects that differ in key order only."""
    return F.sha2(canonical_json(c), 256)


def _is(kind: Column, value: Column, wanted: str) -> Column:
    if wanted == "integer":
        return kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT)$|,0\\)$") | (kind.rlike(_NUMBER) & (value == F.floor(value)))
    return {"string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": kind.rlike(_NUMBER), "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY")}[wanted]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _faults(value: Column, path: Column, schema: Mapping[str, Any]) -> Column:
    """Faults of a VARIANT that is there; ``path`` is its name."""
    if odd := set(schema) - _KNOWN - _NOTES:
        raise ValueError(f"not supported in a schema: {sorted(odd)}")
    return _bound(F.struct(value.alias("v"), F.schema_of_variant(value).alias("kind")), lambda x: _checked(x.v, x.kind, path, schema))


def _found(path: Column, missing: Column, schema: Mapping[str, Any] | None) -> Callable[[Column], Column]:
    """Faults of a property: those of its value, or what it means that there's none."""
    none = F.array().cast(_NONE)
    return lambda child: F.when(child.isNull(), missing).otherwise(none if schema is None else _faults(child, path, schema))


def _checked(v: Column, kind: Column, path: Column, schema: Mapping[str, Any]) -> Column:
    get = lambda as_: F.try_variant_get(v, "$", as_)
    fault = lambda broken, what: F.when(broken, F.concat(path, F.lit(f": {what}")))
    number, string = get("double"), get("string")
    rules, parts = [], []
    if "enum" in schema:
        rules.append(fault(~F.coalesce(string.isin(*schema["enum"]), F.lit(False)), f"not one of {', '.join(map(str, schema['enum']))}"))
    for key, broken, what in (("minimum", lambda x: number < x, "below"), ("maximum", lambda x: number > x, "above")):
        if key in schema:
            rules.append(fault(broken(schema[key]), f"{what} {schema[key]}"))
    for key, broken, what in (("minLength", lambda x: F.length(string) < x, "shorter than"), ("maxLength", lambda x: F.length(string) > x, "longer than")):
        if key in schema:
            rules.append(fault(broken(schema[key]), f"{what} {schema[key]}"))
    if "pattern" in schema:
        rules.append(fault(~string.rlike(schema["pattern"]), f"doesn't match {schema['pattern']}"))
    none, wanted = F.array().cast(_NONE), schema.get("required", [])
    for name in [*wanted, *(n for n in schema.get("properties", {}) if n not in wanted)]:
        its = F.concat(path, F.lit(f".{name}"))
        missing = F.array(F.concat(its, F.lit(": required"))) if name in wanted else none
        under = schema.get("properties", {}).get(name)
        parts.append(_bound(F.try_variant_get(v, f'$["{name}"]', "variant"), _found(its, missing, under)))
    if "items" in schema:
        each = F.transform(get("array<variant>"), lambda x, i: _faults(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"]))
        parts.append(F.coalesce(F.flatten(each), none))
    own = F.array_compact(F.array(*rules)) if rules else none
    inner = F.concat(own, *parts) if parts else own
    if "type" not in schema:
        return inner
    return F.when(_is(kind, number, schema["type"]), inner).otherwise(F.array(F.concat(path, F.lit(f": expected {schema['type']}"))))


def shape_errors(body: Column, schema: Mapping[str, Any]) -> Column:
    """Faults of a JSON text under a schema, in the schema's order, each with its path
    ("$.a.b[2]: below 0"); none: an empty array; null or no JSON: one fault.

    Understands type, required, properties, items, enum (of strings), minimum, maximum,
    minLength, maxLength and pattern; a schema with anything else is refused. A value of
    the wrong type has no other fault."""
    return _bound(F.try_parse_json(body), lambda v: F.when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_faults(v, F.lit("$"), schema)))

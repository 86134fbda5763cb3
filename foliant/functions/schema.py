"""JSON Schema as expressions over VARIANT (V12): a schema is compiled once, and each value gets the path and rule of its first violation."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that rules are made of, and those that say nothing about a value.
RULES = ("type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "items", "required", "properties", "additionalProperties", "anyOf", "$ref")
SILENT = ("$schema", "$id", "$defs", "title", "description", "default", "examples")
#: How deep references may lead: a schema that refers to itself has no end.
DEEPEST = 32
_NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def at(value: Column, key: str) -> Column:
    """A member of an object; SQL's null if it isn't there, VARIANT's if it is null."""
    quoted = key.replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant")


def items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _is(value: Column, kind: Column, name: str) -> Column:
    if name == "integer":
        number = F.try_variant_get(value, "$", "double")
        return kind.rlike(_NUMBER) & (number == F.floor(number))
    return {"object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": kind.rlike(_NUMBER)}[name]


def _resolved(schema: dict, root: dict) -> dict:
    found = root
    for part in schema["$ref"].removeprefix("#/").split("/"):
        found = found[part]
    return found


def violation(value: Column, schema: dict | bool, path: Column | str = "$", root: dict | None = None, depth: int = 0) -> Column:
    """``path: rule`` of the first rule that a VARIANT breaks, or null: rules of the value itself come before those of its members, and members in the
    schema's order. SQL's null breaks the rule *JSON*. A keyword that isn't one of ``RULES`` or ``SILENT`` is an error, as its rule would go unheeded."""
    root = schema if root is None else root
    path = F.lit(path) if isinstance(path, str) else path
    if isinstance(schema, bool):
        return F.lit(None).cast("string") if schema else F.concat(path, F.lit(": false"))
    if unknown := [k for k in schema if k not in RULES + SILENT]:
        raise ValueError(f"no rule for {', '.join(unknown)}")
    if depth > DEEPEST:
        raise ValueError("the schema refers to itself")
    inner = lambda v, s, p: violation(v, s, p, root, depth + 1)
    kind, number, text, array = F.schema_of_variant(value), F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string"), items(value)
    rules: list[Column] = []

    def rule(name: str, broken: Column, only: str | None = None) -> None:
        broken = broken if only is None else _is(value, kind, only) & broken
        rules.append(F.when(F.coalesce(broken, F.lit(False)), F.concat(path, F.lit(f": {name}"))))

    if not depth:
        rule("JSON", value.isNull())
    if "$ref" in schema:
        rules.append(inner(value, _resolved(schema, root), path))
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        broken = F.lit(True)
        for k in kinds:
            broken &= ~_is(value, kind, k)
        rule("type", broken)
    for name, values in (("enum", schema.get("enum", [])), ("const", [schema["const"]] if "const" in schema else [])):
        if name in schema:
            rule(name, ~F.to_json(value).isin([json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in values]))
    for name, broken in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n), ("exclusiveMinimum", lambda n: number <= n), ("exclusiveMaximum", lambda n: number >= n)):
        if name in schema:
            rule(name, broken(schema[name]), "number")
    for name, broken in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n), ("pattern", lambda p: ~text.rlike(p))):
        if name in schema:
            rule(name, broken(schema[name]), "string")
    for name, broken in (("minItems", lambda n: F.size(array) < n), ("maxItems", lambda n: F.size(array) > n)):
        if name in schema:
            rule(name, broken(schema[name]), "array")
    if "anyOf" in schema:
        rule("anyOf", F.greatest(*[inner(value, s, path).isNull() for s in schema["anyOf"]] + [F.lit(False)]) == F.lit(False))
    for key in schema.get("required", []):
        rule(f"required {key}", at(value, key).isNull(), "object")
    for key, member in schema.get("properties", {}).items():
        child = at(value, key)
        rules.append(F.when(child.isNotNull(), inner(child, member, F.concat(path, F.lit(f".{key}")))))
    if "additionalProperties" in schema:
        entries = F.filter(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: ~e["key"].isin(list(schema.get("properties", {}))))
        told = F.transform(entries, lambda e: inner(e["value"], schema["additionalProperties"], F.concat(path, F.lit("."), e["key"])) if schema["additionalProperties"] is not False else F.concat(path, F.lit("."), e["key"], F.lit(": additionalProperties")))
        rules.append(F.get(F.filter(told, lambda t: t.isNotNull()), F.lit(0)))
    if "items" in schema:
        told = F.transform(array, lambda x, i: inner(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        rules.append(F.when(kind.startswith("ARRAY"), F.get(F.filter(told, lambda t: t.isNotNull()), F.lit(0))))
    return F.coalesce(*rules, F.lit(None).cast("string"))

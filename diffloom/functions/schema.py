"""JSON Schema rules as column expressions: every broken rule gives a row with its path.

Read are type, const, enum, required, properties, additionalProperties, items,
minItems, maxItems, uniqueItems, minLength, maxLength, pattern, minimum,
maximum, allOf, anyOf, oneOf, not, if, then, else, and $ref to the schema
itself or its $defs. Other keywords raise an error, so that none is passed
over. A schema that refers to itself is followed so many times as is asked
for; a value that nests more deeply breaks a rule of its own, so that nothing
is left unread in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the types of JSON are called in a variant's schema.
TYPES = {"string": "^STRING$", "integer": r"^(?:BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "null": "^VOID$", "object": "^OBJECT", "array": "^ARRAY"}
READ = {"$ref", "$defs", "anyOf", "not", "uniqueItems", "maxItems", "maxLength", "type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "minLength", "pattern", "minimum", "maximum", "allOf", "oneOf", "if", "then", "else"}
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
NONE = "CAST(array() AS array<struct<path: string, error: string>>)"


def referred(root: dict, ref: str) -> dict:
    """The part of a schema that a reference within it names."""
    if not ref.startswith("#"):
        raise ValueError(f"a reference to another document: {ref}")
    at = root
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if not isinstance(at, dict) or part not in at:
            raise ValueError(f"no such definition: {ref}")
        at = at[part]
    return at


def _literal(v: Column, value) -> Column:
    """Whether a variant is a JSON scalar; numbers are equal by value."""
    kind = F.schema_of_variant(v)
    if value is None:
        return kind.rlike(TYPES["null"])
    if isinstance(value, bool):
        return kind.rlike(TYPES["boolean"]) & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return kind.rlike(TYPES["number"]) & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return kind.rlike(TYPES["string"]) & (F.try_variant_get(v, "$", "string") == value)
    raise ValueError("only scalars are compared")


def _errors(v: Column, schema: dict | bool, path: Column, root: dict, left: int) -> Column:
    if schema is True:
        return F.expr(NONE)
    if schema is False:
        return F.array(F.struct(path.alias("path"), F.lit("is not allowed").alias("error")))
    if unknown := set(schema) - READ - NOTES:
        raise ValueError(f"keywords that aren't read: {sorted(unknown)}")
    inside = lambda v, schema, path: _errors(v, schema, path, root, left)
    if "$ref" in schema:
        # each reference uses up one of those that may be followed
        target = referred(root, schema["$ref"])
        told = _errors(v, target, path, root, left - 1) if left else F.array(F.struct(path.alias("path"), F.lit("nests too deeply to be checked").alias("error")))
        rest = {k: x for k, x in schema.items() if k != "$ref"}
        return F.concat(told, inside(v, rest, path)) if set(rest) - NOTES else told
    kind = F.schema_of_variant(v)
    parts: list[Column] = []

    def rule(broken: Column, error: str, at: Column = path) -> None:
        parts.append(F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(at.alias("path"), F.lit(error).alias("error")))))

    text = F.try_variant_get(v, "$", "string")
    is_ = lambda name: kind.rlike(TYPES[name])
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        good = is_(names[0])
        for n in names[1:]:
            good = good | is_(n)
        rule(~good, f"is not of type {' or '.join(names)}")
    if "const" in schema:
        rule(~_literal(v, schema["const"]), f"is not {schema['const']}")
    if "enum" in schema:
        good = F.lit(False)
        for x in schema["enum"]:
            good = good | F.coalesce(_literal(v, x), F.lit(False))
        rule(~good, "is none of the allowed values")
    if "minLength" in schema:
        rule(is_("string") & (F.length(text) < schema["minLength"]), f"is shorter than {schema['minLength']}")
    if "maxLength" in schema:
        rule(is_("string") & (F.length(text) > schema["maxLength"]), f"is longer than {schema['maxLength']}")
    if "pattern" in schema:
        rule(is_("string") & ~text.rlike(schema["pattern"]), "does not match its pattern")
    number = F.try_variant_get(v, "$", "double")
    if "minimum" in schema:
        rule(is_("number") & (number < schema["minimum"]), f"is below {schema['minimum']}")
    if "maximum" in schema:
        rule(is_("number") & (number > schema["maximum"]), f"is above {schema['maximum']}")
    every = F.when(is_("array"), F.try_variant_get(v, "$", "array<variant>"))
    if "minItems" in schema:
        rule(F.size(every) < schema["minItems"], f"has fewer than {schema['minItems']} items")
    if "maxItems" in schema:
        rule(F.size(every) > schema["maxItems"], f"has more than {schema['maxItems']} items")
    if schema.get("uniqueItems"):
        plain = F.transform(every, lambda x: F.to_json(x))
        rule(F.size(F.array_distinct(plain)) < F.size(plain), "has an item twice")
    if "items" in schema:
        parts.append(F.flatten(F.transform(every, lambda x, i: inside(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    field = lambda name: F.try_variant_get(v, f"$['{name}']", "variant")
    for name in schema.get("required", []):
        rule(is_("object") & field(name).isNull(), "is missing", F.concat(path, F.lit(f".{name}")))
    for name, inner in schema.get("properties", {}).items():
        parts.append(F.when(is_("object") & field(name).isNotNull(), inside(field(name), inner, F.concat(path, F.lit(f".{name}")))))
    if (more := schema.get("additionalProperties", True)) is not True:
        known = list(schema.get("properties", {}))
        extra = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string, variant>")), lambda e: ~e["key"].isin(known))
        parts.append(F.when(is_("object"), F.flatten(F.transform(extra, lambda e: inside(e["value"], more, F.concat(path, F.lit("."), e["key"]))))))
    for inner in schema.get("allOf", []):
        parts.append(inside(v, inner, path))
    fits = lambda key: sum((F.when(F.size(inside(v, s, path)) == 0, 1).otherwise(0) for s in schema[key]), F.lit(0))
    if "anyOf" in schema:
        rule(fits("anyOf") == 0, "fits none of the alternatives")
    if "oneOf" in schema:
        rule(fits("oneOf") != 1, "fits none or several of the alternatives")
    if "not" in schema:
        rule(F.size(inside(v, schema["not"], path)) == 0, "fits what it must not")
    if "if" in schema:
        held = F.size(inside(v, schema["if"], path)) == 0
        branch = lambda key: inside(v, schema[key], path) if key in schema else F.expr(NONE)
        parts.append(F.when(held, branch("then")).otherwise(branch("else")))
    none = F.expr(NONE)
    return F.concat(none, *[F.coalesce(p, none) for p in parts])


def schema_errors(rows: DataFrame, key: str, value: str, schema: dict, depth: int = 3) -> DataFrame:
    """key, path, error of every rule that the JSON text in value breaks; text that is no JSON breaks one. References are followed depth times within each other."""
    v = F.try_parse_json(value)
    found = F.when(v.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("is no JSON").alias("error")))).otherwise(_errors(F.col("_v"), schema, F.lit("$"), schema, depth))
    return rows.withColumn("_v", v).select(key, F.explode(F.array_distinct(found)).alias("e")).select(key, "e.path", "e.error")

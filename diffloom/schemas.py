"""Schemas of the documents that the engine writes and reads, by name."""

from __future__ import annotations

import copy

from .operators.validate import CONFIDENCE, KINDS

_ID = {"type": "string", "pattern": "^[a-z]+_[0-9a-f]{24}$"}
_SIDE = {"enum": ["before", "after"]}
_TEXT = {"type": ["string", "null"]}
_LINE = {"type": "integer", "minimum": 0}

#: The evidence of one file.
EVIDENCE = {
    "title": "evidence of a file", "type": "object", "additionalProperties": False,
    "required": ["id", "path", "status", "units", "spans", "citations"],
    "properties": {
        "id": {"type": "string", "minLength": 1}, "path": {"type": "string", "minLength": 1}, "old_path": _TEXT, "new_path": _TEXT, "status": {"enum": ["added", "deleted", "modified", "renamed", "copied"]},
        "units": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/unit"}}, "spans": {"type": "array", "items": {"$ref": "#/$defs/span"}}, "citations": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/citation"}},
    },
    "not": {"properties": {"old_path": {"type": "null"}, "new_path": {"type": "null"}}},
    "$defs": {
        "id": _ID, "side": _SIDE,
        "unit": {"type": "object", "required": ["id", "kind"], "additionalProperties": False, "properties": {"id": {"$ref": "#/$defs/id"}, "kind": {"enum": ["text", "binary", "mode", "rename", "copy", "submodule", "unsupported"]}}},
        "span": {"type": "object", "required": ["id", "hunk", "side", "start_line", "end_line", "lines"], "additionalProperties": False, "properties": {"id": {"$ref": "#/$defs/id"}, "hunk": {"$ref": "#/$defs/id"}, "side": {"$ref": "#/$defs/side"}, "start_line": _LINE, "end_line": _LINE, "replaces": {"anyOf": [{"$ref": "#/$defs/id"}, {"type": "null"}]}, "lines": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/id"}}}},
        "citation": {"type": "object", "required": ["id", "span", "side", "content_hash", "omitted"], "additionalProperties": False, "properties": {"id": {"$ref": "#/$defs/id"}, "span": {"$ref": "#/$defs/id"}, "side": {"$ref": "#/$defs/side"}, "content_hash": {"type": "string", "pattern": "^[0-9a-f]{64}$"}, "omitted": {"type": "boolean"}, "text": _TEXT}, "if": {"properties": {"omitted": {"const": True}}}, "then": {"properties": {"text": {"type": "null"}}}},
    },
}

#: An explanation: a summary, items and who owns which evidence.
EXPLANATION = {
    "title": "explanation", "type": "object", "required": ["summary", "items", "owners"], "additionalProperties": False,
    "properties": {"summary": {"type": "string", "minLength": 1}, "items": {"type": "array", "items": {"$ref": "#/$defs/item"}}, "owners": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/owner"}}},
    "$defs": {
        "item": {
            "type": "object", "required": ["id", "kind", "title", "references", "confidence"], "additionalProperties": False,
            "properties": {"id": {"type": "string", "minLength": 1}, "kind": {"enum": list(KINDS)}, "title": {"type": "string"}, "before": _TEXT, "after": _TEXT, "absence": _TEXT, "statement": _TEXT, "references": {"type": "array", "items": {"type": "string", "minLength": 1}}, "confidence": {"enum": list(CONFIDENCE)}},
        },
        "owner": {"type": "object", "required": ["evidence", "item"], "additionalProperties": False, "properties": {"evidence": {"type": "string", "minLength": 1}, "item": {"type": "string", "minLength": 1}}},
    },
}

_NAMED = {"evidence": EVIDENCE, "explanation": EXPLANATION}


def load_schema(name: str) -> dict:
    """A copy of a schema; ValueError for an unknown name."""
    if name not in _NAMED:
        raise ValueError(f"unknown schema {name!r}, there are {sorted(_NAMED)}")
    return copy.deepcopy(_NAMED[name])

import json

import pytest
from pyspark.sql import functions as F

from diffloom.functions import schema
from diffloom.operators import release

KEY = "k long, body string"


def strings(value, path="$", keys=False):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            if keys:
                yield f"{path}.{k}<key>", k
            yield from strings(v, f"{path}.{k}", keys)
    elif isinstance(value, list):
        for n, v in enumerate(value):
            yield from strings(v, f"{path}[{n}]", keys)


def nested(depth, leaf):
    out = leaf
    for k in range(depth):
        out = {"a": out, "b": k} if k % 2 else [1, out]
    return out


VALUES = [nested(50, "/home/me/x"), nested(3, "plain"), "top", 5, None, {"a": {}, "b": [], "c": None, "d": [[["x"]]], "e": {"f": "/Users/me"}}, [], {"v": "STRING", "k": [True, 1.5, "z"]}]


@pytest.mark.parametrize("keys", [False, True])
def test_leaves_of_any_depth(spark, keys):
    """A key column of any name, nesting of 50, scalars at the top, text that is no JSON."""
    rows = [(n, json.dumps(v)) for n, v in enumerate(VALUES)] + [(90, "{no"), (91, None), (92, "")]
    df = spark.createDataFrame(rows, KEY)
    got = sorted((r.k, r.path, r.value) for r in release.leaves(df, "k", "body", keys).collect())
    assert got == sorted((n, p, x) for n, v in enumerate(VALUES) for p, x in strings(v, keys=keys))
    assert sorted(r.k for r in release.json_faults(df, "k", "body").collect()) == [90, 91, 92]
    if not keys:
        assert {r.k for r in release.private_strings(release.leaves(df, "k", "body")).collect()} == {0, 5}


TREE = {
    "$defs": {"node": {"type": "object", "required": ["name"], "properties": {"name": {"$ref": "#/$defs/name"}, "children": {"type": "array", "items": {"$ref": "#/$defs/node"}, "uniqueItems": True, "maxItems": 3}}, "additionalProperties": False}, "name": {"type": "string", "minLength": 1, "maxLength": 4, "not": {"const": "root"}}},
    "type": "object", "required": ["tree"], "properties": {"tree": {"$ref": "#/$defs/node"}, "kind": {"enum": ["a", 1, None, True]}, "size": {"anyOf": [{"type": "integer", "minimum": 3}, {"type": "string"}]}, "flag": {"const": 1}, "never": False},
    "additionalProperties": {"type": "boolean"},
}


@pytest.mark.parametrize(
    ("value", "errors"),
    [
        ({"tree": {"name": "a"}}, set()), ({"tree": {"name": "a", "children": [{"name": "b"}, {"name": "c"}]}, "kind": 1, "size": "x", "flag": 1, "more": True}, set()),
        ({"tree": {"name": "root"}}, {("$.tree.name", "fits what it must not")}), ({"tree": {"name": "abcde"}}, {("$.tree.name", "is longer than 4")}), ({"tree": {}}, {("$.tree.name", "is missing")}),
        ({"tree": {"name": "a", "children": [{"name": "b"}, {"name": "b"}]}}, {("$.tree.children", "has an item twice")}), ({"tree": {"name": "a", "children": [{"name": "b", "x": 1}]}}, {("$.tree.children[0].x", "is not allowed")}),
        ({"tree": {"name": "a"}, "kind": 2}, {("$.kind", "is none of the allowed values")}), ({"tree": {"name": "a"}, "kind": None}, set()), ({"tree": {"name": "a"}, "kind": True}, set()), ({"tree": {"name": "a"}, "size": 2}, {("$.size", "fits none of the alternatives")}),
        ({"tree": {"name": "a"}, "flag": "1"}, {("$.flag", "is not 1")}), ({"tree": {"name": "a"}, "never": 1}, {("$.never", "is not allowed")}), ({"tree": {"name": "a"}, "more": "x"}, {("$.more", "is not of type boolean")}),
        ({"tree": {"name": "a", "children": [{"name": n} for n in "bcde"]}}, {("$.tree.children", "has more than 3 items")}),
    ],
)
def test_schemas(spark, value, errors):
    df = spark.createDataFrame([(1, json.dumps(value))], KEY)
    assert {(r.path, r.error) for r in schema.schema_errors(df, "k", "body", TREE).collect()} == errors


def test_what_nests_too_deeply_says_so(spark):
    deep = {"name": "a"}
    for _ in range(4):
        deep = {"name": "a", "children": [deep]}
    df = spark.createDataFrame([(1, json.dumps({"tree": deep}))], KEY)
    assert {r.error for r in schema.schema_errors(df, "k", "body", TREE, depth=3).collect()} == {"nests too deeply to be checked"}


def test_schemas_that_are_refused(spark):
    df = spark.createDataFrame([(1, "{}")], KEY)
    for bad in ({"$ref": "other.json"}, {"$ref": "#/$defs/none"}, {"dependentSchemas": {}}, {"const": {}}):
        with pytest.raises(ValueError):
            schema.schema_errors(df, "k", "body", bad)


def test_links(spark):
    docs = {
        "a/x.md": "# One\n## Two words!\n# One\n[up](../b/y.md) [here](./z.md) [gone](z2.md) [t](../b/y.md \"title\") [s](<../b/y z.md>) [one](#one-1) [two](#two-words) [three](#one-2) [out](../../q.md) [root](/b/y.md#y) [web](https://a/b) [mail](mailto:a@b) [r](//host/x)\n`[code](none.md)` ``[code](`none.md)``\n```\n[block](none.md)\n# One\n```\n~~~ py\n[block](none.md)\n~~~\n",
        "a/z.md": "", "b/y.md": "# Y #\n[deep](../a/./../a/x.md#one)\n[self]()\n[bad](#no)", "b/y z.md": "text",
    }
    got = release.link_errors(spark.createDataFrame(list(docs.items()), "path string, text string"))
    assert sorted((r.path, r.target, r.error) for r in got.collect()) == [("a/x.md", "#one-2", "no such heading"), ("a/x.md", "../../q.md", "leads out of the root"), ("a/x.md", "z2.md", "no such file"), ("b/y.md", "#no", "no such heading")]


def test_sources_that_break_a_parser(spark):
    from diffloom.functions import symbols

    texts = ["x = " + "-" * 20_000 + "1", "not " * 20_000 + "x", "def f(:\n", "\0", "def g():\n    h(1)\n", "(" * 300, None, ""]
    files = spark.createDataFrame([(n, "a.py", t) for n, t in enumerate(texts)], "doc_id long, path string, text string")
    assert {r.name for r in symbols.symbol_table(files).collect()} == {"g"}
    assert {0, 1, 2, 3, 5} >= {r.doc_id for r in symbols.unparsed(files).collect()} >= {1, 2, 3}
    assert [(r.doc_id, r.caller, r.name, r.line) for r in symbols.code_uses(files).collect()] == [(4, "g", "h", 2)]


CODE = {
    "m.py": ("import os.path as p, sys\nfrom a.b import c as d, e\nfrom . import f\nfrom g.h import *\n@deco(1)\ndef one(x=init()):\n    two(x)\n    class K(base()):\n        def three(self):\n            return self.four(lambda: five())\n    return K().run()\nsix()\n",
             {("import", None, "path"), ("import", None, "sys"), ("import", None, "c"), ("import", None, "e"), ("import", None, "f"), ("import", None, "h"), ("call", None, "deco"), ("call", None, "init"), ("call", "one", "two"), ("call", "one", "base"), ("call", "three", "four"), ("call", "three", "five"), ("call", "one", "K"), ("call", "one", "run"), ("call", None, "six")}),
    "m.js": ("import { a } from './lib/util.js';\nimport 'side';\nconst q = require('node/fs');\nfunction f(x) { // g(1) {\n  if (x) { h(`${x} k()`); }\n  /* m( */ return \"n(\" + o (x);\n}\nclass C { run() { return new D(p()); } }\nr('s');\n",
             {("import", None, "util"), ("import", None, "side"), ("import", None, "fs"), ("call", "f", "h"), ("call", "f", "o"), ("call", "C", "run"), ("call", "C", "D"), ("call", "C", "p"), ("call", None, "require"), ("call", None, "r")}),
    "m.rs": ("use std::collections::HashMap;\nfn a(x: i32) -> i32 { b(x) }\n", {("import", None, "HashMap"), ("call", "a", "b")}),
    "m.c": ("#include <stdio.h>\n#include \"own/x.h\"\nstruct s { int n; };\nvoid go(void) { printf(\"{\"); }\n", {("import", None, "stdio"), ("import", None, "x"), ("call", None, "go"), ("call", None, "printf")}),
    "bad.js": ("function f() { g(); \n", set()), "m.txt": ("f(x)", set()),
}


def test_calls_and_imports(spark):
    from diffloom.functions import symbols
    from diffloom.operators import graph

    files = spark.createDataFrame([(n, p, t) for n, (p, (t, _)) in enumerate(CODE.items())], "doc_id long, path string, text string")
    got = {}
    for r in symbols.code_uses(files).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.caller, r.name))
    assert [got.get(n, set()) for n in range(len(CODE))] == [w for _, w in CODE.values()]
    edges = {tuple(r) for r in graph.text_edges(files).select("kind", "symbol", "target", "path").collect()}
    assert {("caller", "two", "one", "m.py"), ("callee", "one", "two", "m.py"), ("importer", "util", None, "m.js")} <= edges and not any(k == "importer" and s == "two" for k, s, *_ in edges)
    assert edges >= {("importer", r[2], None, p) for p, (_, w) in CODE.items() for r in w if r[0] == "import"}
    assert F is not None

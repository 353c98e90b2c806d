"""Symbol ranges of source texts as table functions."""

from __future__ import annotations

import ast
import bisect
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import suffix_of

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Suffixes of languages that are read, and those among them whose blocks are indented or have no braces.
SUPPORTED = [".c", ".cc", ".cpp", ".cxx", ".go", ".h", ".hh", ".hpp", ".java", ".js", ".jsx", ".php", ".py", ".rb", ".rs", ".ts", ".tsx"]
BRACES = [s for s in SUPPORTED if s not in (".py", ".rb")]
#: Declarations of brace languages that are found: a function, class or the like with its opening brace on the line.
DECLARED = r"^\s*((?:(?:export|default|public|private|protected|static|async|pub|abstract|final|inline|extern|unsafe)\s+)*(?:function|func|fn|class|struct|interface|enum|impl|trait)\s+([A-Za-z_$][A-Za-z0-9_$]*)[^{]*\{)"


class PythonSymbols:
    """name, line, end_line of functions and classes, and parsed; a text that doesn't parse gives one row without a name. An identity that repeats is dropped."""

    def eval(self, text: str):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser's own stack ends with the last one
            yield None, None, None, False
            return
        seen: dict[tuple[str, int], int] = {}
        twice = set()
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                key = (node.name, node.lineno)
                twice |= {key} & seen.keys()
                seen[key] = node.end_lineno
        for (name, line), end in sorted(seen.items(), key=lambda x: (x[0][1], x[0][0])):
            if (name, line) not in twice:
                yield name, line, end, True


#: Comments and strings of brace languages, braces, and what begins a string or comment that never ends.
_BRACES = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|[{}"'`]|/\*""", re.DOTALL)
_DECLARED = re.compile(DECLARED, re.ASCII)


def brace_pairs(text: str) -> list[tuple[int, int, int]]:
    """line and column (from 0) of each opening brace outside strings and comments, and the line of its closing one; an unbalanced text has none."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    opened, found = [], []
    for m in _BRACES.finditer(text):
        token = m[0]
        if token == "{":
            opened.append(m.start())
        elif token == "}":
            if not opened:
                return []
            at = opened.pop()
            line = bisect.bisect_right(starts, at)
            found.append((line, at - starts[line - 1], bisect.bisect_right(starts, m.start())))
        elif len(token) == 1 or token == "/*":
            return []
    return [] if opened else sorted(found)


class BraceRanges:
    """The rows of brace_pairs."""

    def eval(self, text: str):
        yield from brace_pairs(text or "")


class BraceSymbols:
    """name, line, end_line of declarations in a text of a brace language; without an end where its brace isn't closed or the text is unbalanced."""

    def eval(self, text: str):
        declared = [(m[2], n, m.end(1) - 1) for n, source in enumerate((text or "").split("\n"), 1) if (m := _DECLARED.match(source))]
        ends = {(line, column): end for line, column, end in brace_pairs(text or "")} if declared else {}
        for name, line, column in declared:
            yield name, line, ends.get((line, column)), True


#: Words of brace languages that stand before a parenthesis without being called, and words after which a name is declared.
NOT_CALLED = frozenset("if for while switch catch return sizeof alignof typeof defined function func fn def class struct interface enum impl trait match new and or not in is do else elif with when using lock foreach synchronized throw await yield case assert".split())
DECLARES = frozenset("function func fn class struct interface enum impl trait new".split())
#: Comments and strings, which hold no code, and then names before a parenthesis, braces and imports.
_TOKEN = re.compile(r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|(?P<open>\{)|(?P<close>\})|(?P<name>[A-Za-z_$][\w$]*)(?P<call>\s*\()?""", re.DOTALL)
_IMPORT = re.compile(r"""^[ \t]*(?:import\s+(?P<es>[^;\n]*?\s+from\s+)?["'](?P<js>[^"'\n]+)["']|import\s+(?:static\s+)?(?P<java>[\w.]+)\s*;|(?:pub\s+)?use\s+(?P<rust>[\w:]+)|\#\s*include\s*[<"](?P<c>[^>"\n]+)[>"]|.*?\brequire\(\s*["'](?P<node>[^"'\n]+)["']\s*\))""", re.MULTILINE)


def last_name(path: str) -> str:
    """The last part of a module's or header's name, without a suffix."""
    end = re.split(r"[/.:]+", re.sub(r"\.[A-Za-z]{1,4}$", "", path) if "/" in path or path.endswith((".h", ".js")) else path)
    return next((x for x in reversed(end) if x), path)


class PythonUses:
    """kind (call or import), caller (the innermost function or class around, null at the top), name and line of what a Python text calls and imports; nothing if it doesn't parse."""

    def eval(self, text: str):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        todo = [(tree, None)]
        while todo:
            node, around = todo.pop()
            if isinstance(node, ast.Call):
                target = node.func
                name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
                if name:
                    yield "call", around, name, node.lineno
            elif isinstance(node, ast.Import):
                for x in node.names:
                    yield "import", around, x.name.rpartition(".")[2], node.lineno
            elif isinstance(node, ast.ImportFrom):
                for x in node.names:
                    name = (node.module or "").rpartition(".")[2] if x.name == "*" else x.name
                    if name:
                        yield "import", around, name, node.lineno
            inner = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else around
            # decorators, defaults and bases are evaluated outside
            body = set(map(id, node.body)) if inner is not around else None
            todo += [(x, inner if body is None or id(x) in body else around) for x in ast.iter_child_nodes(node)]


class BraceUses:
    """The same of a text of a brace language, by its tokens: the innermost declaration whose braces are open is the caller. A text whose braces aren't balanced has none."""

    def eval(self, text: str):
        text, found, stack, declared, before, line, at = text or "", [], [], None, "", 1, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if m["skip"]:
                continue
            if m["open"]:
                stack.append(declared)
                declared, before = None, ""
            elif m["close"]:
                if not stack:
                    return
                stack.pop()
                before = ""
            else:
                name = m["name"]
                if before in DECLARES - {"new"}:
                    declared = name
                elif m["call"] and name not in NOT_CALLED:
                    found.append(("call", next((x for x in reversed(stack) if x), None), name, line))
                before = name
        if stack:
            return
        for m in _IMPORT.finditer(text):
            name = m["js"] or m["java"] or m["rust"] or m["c"] or m["node"]
            found.append(("import", None, last_name(name), text.count("\n", 0, m.start(m.lastgroup)) + 1))
        yield from found


def code_uses(files: DataFrame) -> DataFrame:
    """doc_id, kind, caller, name, line of calls and imports in files (doc_id, path, text), by suffix."""
    end = suffix_of("path")
    columns = "kind string, caller string, name string, line long"
    of = lambda rows, kind: rows.select("doc_id", "text").lateralJoin(F.udtf(kind, returnType=columns)(F.col("text").outer())).drop("text")
    return of(files.where(end == ".py"), PythonUses).unionByName(of(files.where(end.isin(BRACES)), BraceUses))


def python_symbols(texts: DataFrame) -> DataFrame:
    """The columns of texts with name, line, end_line, parsed of each symbol in text."""
    table = F.udtf(PythonSymbols, returnType="name string, line long, end_line long, parsed boolean")
    return texts.lateralJoin(table(F.col("text").outer()))


def brace_ranges(texts: DataFrame) -> DataFrame:
    """The columns of texts with line, column, end_line of each pair of braces in text."""
    table = F.udtf(BraceRanges, returnType="line long, column long, end_line long")
    return texts.lateralJoin(table(F.col("text").outer()))


def declared(texts: DataFrame) -> DataFrame:
    """doc_id, name, line, signature, column (of its brace) of declarations in brace languages, by pattern."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "source")).where(F.col("source").rlike(DECLARED))
    return rows.select("doc_id", F.regexp_extract("source", DECLARED, 2).alias("name"), (F.col("p") + 1).cast("long").alias("line"), F.trim(F.regexp_extract("source", DECLARED, 1)).alias("signature"), (F.instr("source", "{") - 1).cast("long").alias("column"), F.col("source").alias("source"))


def brace_symbols(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """doc_id, name, line, end_line of symbols (doc_id, name, line, signature) whose line has their signature up to the brace, and whose brace is closed. An identity that repeats has no range."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "source")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "source", (F.instr("source", "{") - 1).cast("long").alias("column")).where("column >= 0")
    upto = lambda c: F.trim(F.substring_index(F.col(c), "{", 1))
    told = symbols.where(F.col("signature").contains("{")).join(lines, ["doc_id", "line"]).where(upto("signature") == upto("source"))
    closed = told.select("doc_id", "name", "line", "column").join(brace_ranges(texts.select("doc_id", "text")).select("doc_id", "line", "column", "end_line"), ["doc_id", "line", "column"])
    return closed.groupBy("doc_id", "name", "line").agg(F.count("*").alias("n"), F.min("end_line").alias("end_line")).where("n = 1").drop("n")


def symbol_scan(files: DataFrame) -> DataFrame:
    """doc_id, python, name, line, end_line, parsed of files (doc_id, path, text): every symbol, found in one pass over each text, and a row without a name for a Python text that doesn't parse."""
    end, columns = suffix_of("path"), "name string, line long, end_line long, parsed boolean"
    of = lambda rows, kind, python: rows.select("doc_id", "text").lateralJoin(F.udtf(kind, returnType=columns)(F.col("text").outer())).select("doc_id", F.lit(python).alias("python"), "name", "line", "end_line", "parsed")
    return of(files.where(end == ".py"), PythonSymbols, True).unionByName(of(files.where(end.isin(BRACES)), BraceSymbols, False))


def symbol_table(files: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """doc_id, name, line, end_line (null without a verified range), confidence and provenance of the symbols of files (doc_id, path, text), by suffix.

    Python is parsed; declarations of brace languages are found by pattern, so
    they are inferred. Other languages have no symbols. scan: the written
    symbol_scan of the files, if there is one.
    """
    rows = (symbol_scan(files) if scan is None else scan).where("parsed")
    return rows.select("doc_id", "name", "line", "end_line", F.when(F.col("python"), "extracted").otherwise("inferred").alias("confidence"), F.when(F.col("python"), "parser:ast").otherwise("parser:regex").alias("provenance"))


def unparsed(files: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """doc_id of Python files that don't parse."""
    rows = python_symbols(files.where(suffix_of("path") == ".py").select("doc_id", "text")) if scan is None else scan
    return rows.where("NOT parsed").select("doc_id")

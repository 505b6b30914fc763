"""Declarations of Java sources: packages, imports, classes, methods, fields and calls.

A permissive scanner over comments, literals, words and marks.  A file that can't be read gives a parse error and no
classes, and never fails the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<w>[^\W\d][\w$]*)|(?P<n>\d[\w.]*)|(?P<m>[^\w\s])", re.S)
_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
_NO_CALLS = frozenset("if for while switch catch synchronized return new super this assert try throw else do case".split())
_KINDS = frozenset(("class", "interface", "enum"))

METHOD = ("struct<name:string,start_line:int,end_line:int,source_code:string,return_type:string,parameters:array<string>,"
          "modifiers:array<string>,calls:array<string>>")
CLASS = (f"struct<name:string,extends:string,implements:array<string>,modifiers:array<string>,is_interface:boolean,"
         f"fields:array<string>,methods:array<{METHOD}>>")
PARSED = f"package string, imports array<string>, classes array<{CLASS}>, parse_errors array<string>"


class _Scanner:
    def __init__(self, source: str) -> None:
        self.source = source
        found = [m for m in _TOKEN.finditer(source) if m.lastgroup]
        self.text = [m.group() for m in found]
        self.kind = [m.lastgroup for m in found]
        self.at = [m.start() for m in found]
        self.end = [m.end() for m in found]

    def close(self, i: int) -> int:
        """Index of the bracket that closes the one at ``i``."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        opening, closing = self.text[i], pairs[self.text[i]]
        for k in range(i, len(self.text)):
            if self.kind[k] == "m":
                depth += (self.text[k] == opening) - (self.text[k] == closing)
                if depth == 0:
                    return k
        raise ValueError(f"Expected '{closing}'")

    def line(self, i: int) -> int:
        return self.source.count("\n", 0, self.at[i]) + 1

    def calls(self, a: int, b: int) -> list[str]:
        out = set()
        for i in range(a + 1, b):
            if self.text[i] == "(" and self.kind[i - 1] == "w" and self.text[i - 1] not in _NO_CALLS:
                name, k = self.text[i - 1], i - 2
                if self.text[k] == "new" or self.text[k] == "." and self.text[k - 1] == "super":
                    continue
                parts = [name]
                while k > a and self.text[k] == "." and self.kind[k - 1] == "w" and self.text[k - 1] not in ("this", "super"):
                    parts.insert(0, self.text[k - 1])
                    k -= 2
                if k > a and self.text[k] == ".":  # a chained call has no plain qualifier
                    parts = [name]
                if not (k >= a and self.text[k] == "new"):
                    out.add(".".join(parts))
        return sorted(out)


def _types(s: _Scanner, a: int, b: int) -> list[str]:
    """Names of a comma-separated type list, without type arguments."""
    out, depth, fresh = [], 0, True
    for i in range(a, b):
        depth += (s.text[i] == "<") - (s.text[i] == ">")
        if depth == 0 and s.text[i] == ",":
            fresh = True
        elif depth == 0 and s.kind[i] == "w" and fresh:
            out.append(s.text[i])
            fresh = False
    return out


def _rendered(s: _Scanner, a: int, b: int) -> str:
    """A type as text: arguments in brackets, no array marks."""
    text = "".join(t if t not in (",",) else ", " for t in s.text[a:b] if t not in ("[", "]", "...", "."))
    return text or "void"


def _members(s: _Scanner, a: int, b: int, class_name: str) -> tuple[list[str], list[dict]]:
    fields, methods, constructors = [], [], []
    i = start = a
    while i < b:
        t = s.text[i]
        if t == "@" and s.kind[i] == "m" and s.text[i + 1] != "interface":
            i += 2
            while i < b and s.text[i] == ".":
                i += 2
            if i < b and s.text[i] == "(":
                i = s.close(i) + 1
            continue
        if t in _KINDS and s.kind[i] == "w":
            while s.text[i] != "{":
                i += 1
            i = start = s.close(i) + 1
            continue
        if t == ";" or t == "{" or t == "=":
            if t == "=" or t == ";":
                head = _plain(s, start, i)
                mods = [s.text[k] for k in head if s.text[k] in _MODIFIERS]
                rest = [k for k in head if s.text[k] not in _MODIFIERS]
                if len(rest) > 1:
                    fields.append(" ".join([*mods, _rendered(s, rest[0], rest[-1]), s.text[rest[-1]]]).strip())
                while i < b and s.text[i] != ";":
                    i = s.close(i) + 1 if s.text[i] in "([{" else i + 1
            else:
                i = s.close(i)
            i += 1
            start = i
            continue
        if t == "(":
            head = _plain(s, start, i)
            mods = [s.text[k] for k in head if s.text[k] in _MODIFIERS]
            rest = [k for k in head if s.text[k] not in _MODIFIERS]
            closing = s.close(i)
            body = closing + 1
            while body < b and s.text[body] not in "{;":
                body += 1
            last = s.close(body) if body < b and s.text[body] == "{" else body
            if rest:
                name = s.text[rest[-1]]
                first = head[0]
                made = name == class_name and len(rest) == 1
                begin, stop = s.line(first), s.line(min(last, len(s.text) - 1))
                m = {"name": "__init__" if made else name, "start_line": begin, "end_line": stop,
                     "source_code": "\n".join(s.source.split("\n")[begin - 1:stop]),
                     "return_type": "void" if made or len(rest) == 1 else _rendered(s, rest[0], rest[-1]),
                     "parameters": _parameters(s, i + 1, closing), "modifiers": sorted(set(mods)),
                     "calls": s.calls(body, last) if last > body else []}
                (constructors if made else methods).append(m)
            i = start = last + 1
            continue
        i += 1
    return fields, methods + constructors


def _plain(s: _Scanner, a: int, b: int) -> list[int]:
    """Indexes of a declaration's head without annotations and leading type parameters."""
    out, i = [], a
    while i < b:
        if s.text[i] == "@":
            i += 2
            while i < b and s.text[i] == ".":
                i += 2
            if i < b and s.text[i] == "(":
                i = s.close(i) + 1
        elif s.text[i] == "<" and all(s.text[k] in _MODIFIERS for k in out):
            depth = 0
            while i < b:
                depth += (s.text[i] == "<") - (s.text[i] == ">")
                i += 1
                if depth == 0:
                    break
        else:
            out.append(i)
            i += 1
    return out


def _parameters(s: _Scanner, a: int, b: int) -> list[str]:
    out, depth, start = [], 0, a
    for i in range(a, b + 1):
        depth += (s.text[i] in "<(") - (s.text[i] in ">)") if i < b else 0
        if i == b or depth == 0 and s.text[i] == ",":
            part = [k for k in _plain(s, start, i) if s.text[k] not in ("final",)]
            if len(part) > 1:
                out.append(f"{_rendered(s, part[0], part[-1])} {s.text[part[-1]]}")
            start = i + 1
    return out


def parse(source: str) -> dict:
    """package, imports, classes and parse_errors of one source."""
    out: dict = {"package": "", "imports": [], "classes": [], "parse_errors": []}
    try:
        s = _Scanner(source)
        i, n = 0, len(s.text)
        while i < n:
            t = s.text[i]
            if t == "package":
                end = s.text.index(";", i)
                out["package"], i = "".join(s.text[i + 1:end]), end + 1
            elif t == "import":
                end = s.text.index(";", i)
                parts = [x for x in s.text[i + 1:end] if x != "static"]
                out["imports"].append("".join(parts).removesuffix(".*"))
                i = end + 1
            elif t in _KINDS and s.kind[i] == "w" and (i == 0 or s.text[i - 1] != "@"):
                head = i
                first = i
                while first > 0 and s.text[first - 1] in _MODIFIERS:
                    first -= 1
                brace = s.text.index("{", i)
                end = s.close(brace)
                marks = {s.text[k]: k for k in range(head, brace) if s.text[k] in ("extends", "implements")}
                ext, imp = marks.get("extends"), marks.get("implements")
                name = s.text[head + 1]
                begin = brace
                if t == "enum":
                    begin = next((k for k in range(brace + 1, end) if s.text[k] == ";"), end - 1)
                fields, methods = _members(s, begin + 1, end, name)
                bases = _types(s, ext + 1, imp if imp and imp > ext else brace) if ext else []
                out["classes"].append({
                    "name": name, "extends": bases[0] if bases else None, "implements": _types(s, imp + 1, brace) if imp else [],
                    "modifiers": sorted(set(s.text[first:head])), "is_interface": t == "interface", "fields": fields, "methods": methods})
                i = end + 1
            else:
                i += 1
    except (ValueError, IndexError) as e:
        out["classes"], out["parse_errors"] = [], [f"Syntax error: {e}"]
    return out


def parsed_files(files: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with package, imports, classes (nested) and parse_errors; null sources give an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(t) if t is not None else {"package": "", "imports": [], "classes": [], "parse_errors": ["Parse error: no source"]}
                    for t in pdf.pop("_source")]
            yield pdf.assign(**{c: [r[c] for r in rows] for c in ("package", "imports", "classes", "parse_errors")})

    rows = files.select(*keep, F.col("raw_source").alias("_source"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(run, f"{schema}, {PARSED}")


def all_methods(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per method: ``keep``, class_name, qualified_name, is_entry_point and the method's columns."""
    from codeloom.functions import text as T

    c = parsed.select(*keep, F.explode("classes").alias("c"))
    m = c.select(*keep, F.col("c.name").alias("class_name"), F.explode("c.methods").alias("m")).select(*keep, "class_name", "m.*")
    return m.withColumns({"qualified_name": F.concat_ws(".", "class_name", "name"),
                          "is_entry_point": T.is_entry_point(F.col("name"), F.col("modifiers"))})


def method_end_lines(files: DataFrame, methods: DataFrame) -> DataFrame:
    """(method_id, end_line): first line from start_line on where an opening brace was seen and the depth is back at 0.

    Braces in literals and comments count; without such a line the file's last line ends the method.  The depths are a
    running sum over the lines of a file, kept as one list that each of its methods is looked up in.
    """
    from codeloom.operators.lines import line_table

    lines = line_table(files.where("file_id is not null"), "file_id", "raw_source")
    count = lambda c: (F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))).cast("int")
    listed = lines.select("file_id", F.struct("ln", count("{").alias("opens"), count("}").alias("closes")).alias("l")).groupBy("file_id").agg(
        F.array_sort(F.collect_list("l")).alias("lines"))
    wanted = methods.select("file_id", "method_id", "start_line").join(listed, "file_id").where(
        (F.col("start_line") >= 1) & (F.col("start_line") <= F.size("lines")))
    none = F.lit(None).cast("int")
    # (depth, whether a brace was opened, the end once it is found)
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("seen"), none.alias("end"))

    def step(x: Column, line: Column) -> Column:
        depth, seen = x.depth + line.opens - line.closes, x.seen | (line.opens > 0)
        return F.struct(depth.alias("depth"), seen.alias("seen"),
                        F.coalesce(x.end, F.when(seen & (depth <= 0), line.ln.cast("int"))).alias("end"))

    found = F.aggregate(F.slice("lines", F.col("start_line"), F.size("lines")), state, step, lambda x: x.end)
    return wanted.select("method_id", F.coalesce(found, F.size("lines")).alias("end_line"))

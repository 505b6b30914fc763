"""Island grammars: functions with their documentation in Java, JavaScript and Python.

Islands are comments, annotations, signatures and balanced bodies; all else is water that the scanner passes over.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple


class Function(NamedTuple):
    qualified_name: str
    start_line: int
    code: str
    comment: str | None


#: Comments, literals, annotations, words and the marks that delimit declarations. An unclosed literal ends its line.
_SHORE = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<literal>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z))
      |(?P<note>@(?!interface\b)\w[\w.]*)
      |(?P<word>[^\W\d][\w$]*)
      |(?P<mark>=>|->|[{}();,=])""",
    re.S | re.X,
)
# Words that open blocks which are no functions, and words that open a type.
_BLOCKS = frozenset("if for while switch try catch finally do else synchronized return new case default static with".split())
_TYPES = frozenset("class interface enum record".split())


def header_comment(code: str) -> str | None:
    """The comment directly above the declaration with which ``code`` begins, with only annotations between.

    Successive line comments are one comment. Null if the declaration has none.
    """
    found: list[str] = []
    depth, end, annotated = 0, 0, False
    for m in _SHORE.finditer(code):
        kind, gap = m.lastgroup, code[end:m.start()]
        if kind == "comment":
            text = m.group()
            if found and not annotated and text.startswith("//") and found[-1].startswith("//") and gap.count("\n") <= 1:
                found.append(text)
            else:
                found = [text]
            annotated = False
        elif kind == "note" and depth == 0:
            annotated = True
        elif annotated and kind == "mark" and m.group() in "()":
            depth += 1 if m.group() == "(" else -1
        elif depth == 0:
            break
        end = m.end()
    return "\n".join(found) or None


def _line_ends(source: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", source)]


def _closing(tokens: list[re.Match], at: int) -> int:
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].lastgroup == "mark":
            depth += {"{": 1, "}": -1}.get(tokens[i].group(), 0)
            if depth == 0:
                return i
    return -1


def _argument(head: list[re.Match]) -> list[re.Match]:
    """The part of ``head`` behind its last open bracket: of ``f(a, function b() {`` only ``function b()``."""
    opened: list[int] = []
    for i, m in enumerate(head):
        if m.group() == "(":
            opened.append(i)
        elif m.group() == ")" and opened:
            opened.pop()
    if not opened:
        return head
    rest = head[opened[-1] + 1:]
    return next((rest[i:] for i in range(len(rest)) if rest[i].group() == "function"), [])


def _declared(head: list[re.Match]) -> int:
    """Where the declaration begins that ends ``head``: before a named function with its comments and notes, else 0."""
    at = next((i for i in range(len(head) - 2, -1, -1) if head[i].group() == "function"
               and next((m.lastgroup for m in head[i + 1:] if m.group() != "*"), "") == "word"), 0)
    while at and (head[at - 1].lastgroup in ("comment", "note") or head[at - 1].group() in ("async", "export", "default")):
        at -= 1
    return at


def _name(head: list[re.Match]) -> str | None:
    """The function that a declaration's head declares: the word before its parameter list."""
    head = _argument(head)
    words = [m.group() for m in head if m.lastgroup == "word"]
    if not words or words[0] in _BLOCKS and words[0] != "static" or "new" in words:
        return None
    for i, (a, b) in enumerate(zip(head, head[1:])):
        if b.group() == "(" and a.lastgroup == "word" and a.group() not in _BLOCKS:
            if a.group() == "function" or a.group() == "async":
                break
            after = next((m.group() for m in head[_bracket_end(head, i + 1):] if m.lastgroup == "word"), "throws")
            if after != "throws":
                continue  # a call of a statement before
            return a.group()
        if a.group() in ("=", "=>"):
            break
    # name = function (...) / name = (...) =>
    marks = [m.group() for m in head]
    if "=" in marks and ("=>" in marks or "function" in marks):
        before = head[marks.index("=") - 1]
        return before.group() if before.lastgroup == "word" else None
    return None


def _bracket_end(head: list[re.Match], at: int) -> int:
    depth = 0
    for i in range(at, len(head)):
        depth += {"(": 1, ")": -1}.get(head[i].group(), 0)
        if depth == 0:
            return i + 1
    return len(head)


def brace_functions(source: str) -> Iterator[Function]:
    """Functions of a Java or JavaScript source whose body is balanced, those inside of other functions too."""
    tokens, ends = list(_SHORE.finditer(source)), _line_ends(source)
    scopes: list[str | None] = []
    head: list[re.Match] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        text = t.group()
        if t.lastgroup != "mark" or text not in "{};":
            head.append(t)
        elif text == "{":
            while head and head[0].group() in (",", ")"):
                head.pop(0)  # of what stands before
            head = head[_declared(head):]
            core = [m for m in head if m.lastgroup != "comment"]
            words = [m.group() for m in core if m.lastgroup == "word"]
            kind = next((k for k, w in enumerate(words[:-1]) if w in _TYPES), None)
            plain = [m for m in core if m.lastgroup != "note"]
            name = None if kind is not None else _name(_without_annotation_arguments(core))
            if kind is not None:
                scopes.append(words[kind + 1])
            elif name and plain:
                end = _closing(tokens, i)
                if end > 0:
                    first = core[0].start()
                    comment = header_comment(source[head[0].start():t.end()])
                    owner = [s for s in scopes if s]
                    yield Function(".".join([*owner[-1:], name]), bisect_left(ends, first) + 1,
                                   source[first:tokens[end].end()], comment)
                    scopes.append(name)
                else:
                    scopes.append(None)
            else:
                scopes.append(None)
            head = []
        else:
            if text == "}" and scopes:
                scopes.pop()
            # Parameters and for-headers hold semicolons only inside brackets; those heads are no declarations.
            head = []
        i += 1


def _without_annotation_arguments(core: list[re.Match]) -> list[re.Match]:
    out, depth, after = [], 0, False
    for m in core:
        if m.lastgroup == "note":
            after = True
        elif after and m.group() == "(":
            depth += 1
        elif after and depth and m.group() == ")":
            depth -= 1
        elif depth == 0:
            after = False
            out.append(m)
    return out


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)
_DOCSTRING = re.compile(r"\s*[rRuU]?(\"\"\"|''')(.*?)\1", re.S)


def python_functions(source: str) -> Iterator[Function]:
    """Functions of a Python source; the docstring documents them, else the comment lines above."""
    lines, ends = source.split("\n"), _line_ends(source)
    owners: list[tuple[int, str]] = []
    for m in _DEF.finditer(source):
        indent, kind, name = len(m[1].expandtabs()), m[2], m[3]
        while owners and owners[-1][0] >= indent:
            owners.pop()
        if kind == "class":
            owners.append((indent, name))
            continue
        first = bisect_left(ends, m.start())
        depth, at = 0, source.find("(", m.end())
        while 0 <= at < len(source):  # to the end of the signature
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(source[at], 0)
            if depth == 0 and source[at] == ":":
                break
            at += 1
        if at < 0 or at >= len(source):
            continue
        last = bisect_left(ends, at) + 1
        while last < len(lines) and (not lines[last].strip() or
                                     len(lines[last].expandtabs()) - len(lines[last].expandtabs().lstrip()) > indent):
            last += 1
        code = "\n".join(lines[first:last]).rstrip()
        doc = _DOCSTRING.match(source, at + 1)
        comment = doc[2] if doc else None
        if comment is None:
            above = []
            k = first - 1
            while k >= 0 and lines[k].strip().startswith(("#", "@")):
                above += [lines[k]] if lines[k].strip().startswith("#") else []
                k -= 1
            comment = "\n".join(reversed(above)) or None
        yield Function(".".join([*(o for _, o in owners[-1:]), name]), first + 1, code, comment)


def functions(file_path: str, source: str) -> Iterator[Function]:
    """Functions of a .java, .js or .py source; none for other suffixes."""
    suffix = file_path.rsplit(".", 1)[-1].lower()
    if suffix in ("java", "js"):
        yield from brace_functions(source)
    elif suffix == "py":
        yield from python_functions(source)

"""Lexers that can start in the middle of a file: class streams, lexer-state maps and bracket summaries of line chunks.

A lexer turns text into a stream with one character for each token: its class, or the bracket itself.  Comments and
blanks leave nothing, except that line ends are kept where the language gives them a meaning.  A chunk is lexed for
every state in which it could be entered; :func:`joined` is associative, so chunks may be joined in any grouping.
"""

from __future__ import annotations

import re
from itertools import accumulate
from typing import NamedTuple

CODE, COMMENT, LONG1, LONG2, BROKEN = "code", "comment", "long1", "long2", "broken"
#: Classes of what is still open where a chunk ends.
_OPEN = {"\x01": COMMENT, "\x02": LONG1, "\x03": LONG2}
_OPENED = {v: k for k, v in _OPEN.items()}
#: A line end in Python is one character that tells the next line's indentation.
INDENT = 0xE000
WIDEST = 0x18FF

# Keywords by class.
_JAVA_WORDS = {
    **dict.fromkeys("int long double float boolean char byte short void".split(), "t"),
    **dict.fromkeys("true false null".split(), "n"), **dict.fromkeys("this super".split(), "i"),
    "class": "c", "interface": "f", "enum": "e", "record": "r", "extends": "x", "implements": "G", "permits": "v", "sealed": "g", "non-sealed": "m",
    "if": "I", "while": "W", "for": "F", "do": "D", "else": "E", "switch": "S", "case": "K", "default": "d", "return": "R", "yield": "y",
    "throw": "T", "break": "J", "continue": "J", "try": "Y", "catch": "H", "finally": "Z", "new": "N", "instanceof": "O",
    "throws": "w", "package": "a", "import": "q", "assert": "A", "synchronized": "s", "goto": "#", "const": "#", "_": "#",
}
_JAVA_MODIFIERS = "public protected private static final abstract native transient volatile strictfp".split()
_JS_WORDS = {
    **dict.fromkeys("true false null this super".split(), "n"), "var": "v", "let": "v", "const": "k",
    **dict.fromkeys("typeof void delete await new".split(), "!"), **dict.fromkeys("in instanceof".split(), "b"),
    "function": "f", "class": "c", "extends": "x", "if": "I", "while": "W", "with": "W", "for": "F", "do": "D", "else": "E",
    "switch": "S", "case": "K", "default": "d", "return": "R", "throw": "T", "break": "J", "continue": "J", "try": "Y",
    "catch": "H", "finally": "Z", "import": "q", "export": "e", "debugger": "n", "enum": "#", "yield": "G", "async": "y",
    **dict.fromkeys("get set static".split(), "g"), "of": "O",
}
_PY_WORDS = {
    **dict.fromkeys("False None True".split(), "n"), "and": "o", "or": "o", "in": "a", "is": "j", "not": "h", "await": "!", "if": "f", "else": "e", "elif": "l",
    "while": "w", "for": "r", "try": "t", "except": "x", "finally": "y", "with": "W", "def": "d", "class": "c", "return": "R", "yield": "Y",
    "lambda": "L", "import": "q", "from": "Q", "as": "A", **dict.fromkeys("pass break continue".split(), "K"), "raise": "T",
    **dict.fromkeys("global nonlocal".split(), "g"), "del": "D", "assert": "S", "async": "z", "match": "m", "case": "k", "type": "u",
}
_WORDS = {"java": _JAVA_WORDS, "js": _JS_WORDS, "py": _PY_WORDS, "json": dict.fromkeys("true false null".split(), "n")}
_BRACE_OPS = {"++": "u", "--": "u", "!": "!", "~": "!", "+": "+", "-": "+", "?": "?", ":": ":", ";": ";", ",": ",", ".": ".", "?.": ".",
              "...": "~", "->": "L", "=>": "L", "::": "M", "@": "@", "<": "<", ">": ">", "=": "="}
_PY_OPS = {"+": "+", "-": "+", "~": "!", "*": "*", "**": "^", "@": "@", "=": "=", ":=": "V", ":": ":", ",": ",", ".": ".", "...": "n", ";": ";", "->": ">"}

_MODIFIER_RUN = rf"(?:(?:{'|'.join(_JAVA_MODIFIERS)})(?![\w$])\s*)+"
_NUMBER = (r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)")
_TEMPLATE = re.compile(r"`(?>\\.|\$\{(?>[^`{}]|`(?>\\.|[^`\\])*+`|\{[^{}]*\})*+\}|[^`\\])*+`", re.S)
#: A formatted string of one line, whose fields may hold its own quotes.
_FIELD = r"\{(?>[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*+\}"
_FORMATTED = rf"(?i:[ft]r?|r[ft])(?:\"(?!\"\")(?:\\.|\{{\{{|{_FIELD}|[^\"\\\n{{])*\"|'(?!'')(?:\\.|\{{\{{|{_FIELD}|[^'\\\n{{])*')"
#: Patterns that cover a text without a gap; the last one takes what is no token.
_TILES = {
    "java": re.compile(
        r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\"[ \t\f]*(?:\r?\n(?:\\.|[^\\])*?(?:\"\"\"|\Z)|\r?\Z)|\"(?:\\.|[^\"\\\n])*\""
        r"|'(?:\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.)|[^'\\\n])'|" + _MODIFIER_RUN + r"|non-sealed(?![\w$])|(?:[^\W\d]|\$)[\w$]*|" + _NUMBER + r"[lLfFdD]?(?![\w$])"
        r"|\d[\w$]*|->|::|\.\.\.|\+\+|--|>>>=|<<=|>>=|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||<<|.", re.S),
    "js": re.compile(
        r"(?:(?<=[\w$)\]}\"'`])|(?<=\*/))" + "".join(rf"(?<!\b{w})" for w in (
            "return typeof case in of new delete void throw do else await yield instanceof").split()) + r"\s*/(?![/*])=?"
        r"|\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\#![^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
        r"|" + _TEMPLATE.pattern + r"|`(?:\\.|[^`\\])*\Z"
        r"|/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*|new\s*\.\s*target(?![\w$])|import\s*\.\s*meta(?![\w$])|yield\s*\*"
        r"|(?:[^\W\d]|\$|\#(?=[^\W\d]|\$))[\w$]*|(?:" + _NUMBER + r"|0[oO][0-7_]+)n?(?![\w$])|\d[\w$]*"
        r"|=>|\.\.\.|\?\.(?!\d)|\+\+|--|\*\*=|\*\*|>>>=|<<=|>>=|&&=|\|\|=|\?\?=|\?\?|[-+*/%&|^]=|===|!==|==|!=|<=|>=|&&|\|\||<<|>>>|>>|.", re.S),
    "py": re.compile(
        r"(?:[ \t\f]*(?:\#[^\n]*)?\r?\n)+[ \t\f]*|[ \t\f]+|\#[^\n]*|\\\r?\n"
        r"|" + _FORMATTED + r"|(?i:[rbuft]{0,2})(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?!\"\")(?:\\.|[^\"\\\n])*\"|'(?!'')(?:\\.|[^'\\\n])*')"
        r"|[^\W\d]\w*|(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?!0+_?[1-9](?:_?\d)*(?![\d_.eEjJ]))"
        r"(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)|\d\w*"
        r"|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%&|^@]=|==|!=|<=|>=|\*\*|//|<<|>>|.", re.S),
    "json": re.compile(
        r"[ \t\r\n]+|\"(?:\\(?:[\"\\/bfnrt]|u[\da-fA-F]{4})|[^\"\\\x00-\x1f])*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[^\W\d]\w*|.", re.S),
}
#: From the start of a chunk to the end of what is open there.
_ENDS = {COMMENT: dict.fromkeys(("java", "js"), re.compile(r".*?\*/", re.S)),
         LONG1: {"java": re.compile(r'(?:\\.|[^\\])*?"""', re.S), "js": re.compile(r"(?:\\.|[^\\])*?`", re.S), "py": re.compile(r'(?:\\.|[^\\])*?"""', re.S)},
         LONG2: {"py": re.compile(r"(?:\\.|[^\\])*?'''", re.S)}}
_STATES = {"java": (CODE, COMMENT, LONG1), "js": (CODE, COMMENT, LONG1), "py": (CODE, LONG1, LONG2), "json": (CODE,)}
PAIRS = {")": "(", "]": "[", "}": "{"}
BRACKET = re.compile(r"[()\[\]{}]")


class _Classes(dict):
    """The class of each token text of a language; remembered up to a bound."""

    def __init__(self, language: str) -> None:
        super().__init__()
        self.language, self.words = language, _WORDS[language]

    def __missing__(self, token: str) -> str:
        if len(self) > 1 << 17:
            self.clear()
        self[token] = c = getattr(self, "_" + self.language)(token)
        return c

    def _braces(self, t: str) -> str:
        first = t[0]
        if t in "()[]{}":
            return t
        if first.isdigit() or first == "." and len(t) > 1 and t[1].isdigit():
            return "n" if re.fullmatch(_NUMBER + r"[lLfFdDn]?|0[oO][0-7_]+n?", t) else "X"
        if t in _BRACE_OPS:
            return _BRACE_OPS[t]
        if first in "\"'`":
            return "n" if len(t) > 1 else "X"
        if first.isalpha() or first in "_$#" and len(t) > 1 or t in ("_", "$"):
            return self.words.get(t, "i")
        if t in ("==", "!=", "<=", ">=", "===", "!=="):
            return "b"
        return "=" if t[-1] == "=" else "b" if first in "*/%&|^<>?" else "X"

    def _java(self, t: str) -> str:
        first = t[0]
        if first.isspace() or t.startswith("//"):
            return ""
        if t.startswith("/*"):
            return "" if len(t) > 3 and t.endswith("*/") else _OPENED[COMMENT]
        if t.startswith('"""'):
            return "n" if re.fullmatch(r'"""[ \t\f]*\r?\n(?:\\.|[^\\])*?"""', t, re.S) else _OPENED[LONG1]
        runs = t.split()
        if runs[0] in _JAVA_MODIFIERS:
            return "m" if len(set(runs)) == len(runs) else "#"  # a repeated modifier
        return self._braces(t)

    def _js(self, t: str) -> str:
        first = t[0]
        if first.isspace() and t.strip()[:1] != "/":
            return "\n" if "\n" in t else ""
        if t.startswith("//") or t.startswith("#!"):
            return ""
        if t.startswith("/*"):
            return ("\n" if "\n" in t else "") if len(t) > 3 and t.endswith("*/") else _OPENED[COMMENT]
        if first == "`":
            return "`" if _TEMPLATE.fullmatch(t) else _OPENED[LONG1]
        if t.strip() in ("/", "/="):
            return "=" if t.endswith("=") else "b"
        if first == "/" and len(t) > 1:
            return "n"
        if first in "niy" and re.search(r"\W", t):
            return "G" if t.startswith("yield") else "n"
        return self._braces(t)

    def _py(self, t: str) -> str:
        if t[0] in " \t\f#\r\n\\":
            if "\n" not in t or t[0] == "\\" and len(t) > 1:
                return "X" if t == "\\" else ""
            width = len(t[t.rfind("\n") + 1:].replace("\f", "").expandtabs(8))
            return chr(INDENT + min(width, WIDEST))
        if t[-1] in "\"'":
            m = re.fullmatch(r"(?i:[rbuft]{0,2})(?:(\"\"\"|''')(?:\\.|[^\\])*?\1|(?:\"(?!\"\")(?:\\.|[^\"\\\n])*\"|'(?!'')(?:\\.|[^'\\\n])*'))", t, re.S)
            if m or re.fullmatch(_FORMATTED, t, re.S):
                return "s"
        m = re.match(r"(?i:[rbuft]{0,2})(\"\"\"|''')", t)
        if m:
            return _OPENED[LONG1 if m[1] == '"""' else LONG2]
        if t in "()[]{}":
            return t
        if t[0].isdigit() or t[0] == "." and t[1:2].isdigit():
            return "n" if re.fullmatch(_PY_NUMBER, t) else "X"
        if t.isidentifier():
            return self.words.get(t, "i")
        if t in _PY_OPS:
            return _PY_OPS[t]
        if t in ("==", "!=", "<=", ">=", "<", ">", "/", "//", "%", "&", "|", "^", "<<", ">>"):
            return "b"
        return "~" if t[-1] == "=" and len(t) > 1 else "X"

    def _json(self, t: str) -> str:
        if t[0] in " \t\r\n":
            return ""
        if t in "()[]{}:,":
            return t
        if t[0] == '"' and len(t) > 1:
            return "s"
        if t[0].isdigit() or t[0] == "-" and len(t) > 1:
            return "n"
        return self.words.get(t, "X")


_PY_NUMBER = (r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?!0+_?[1-9](?:_?\d)*$)"
              r"(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?")
_CLASSES = {k: _Classes(k) for k in _TILES}


class Summary(NamedTuple):
    """What a chunk does for one entry state: the state it ends in, its unmatched brackets, and its stream."""

    state: str
    closed: str
    opened: str
    stream: str


def _summed(stream: str) -> Summary:
    state = CODE
    if stream and stream[-1] in _OPEN:
        state, stream = _OPEN[stream[-1]], stream[:-1]
    opened, closed = [], []
    for b in BRACKET.findall(stream):
        if b in "([{":
            opened.append(b)
        elif not opened:
            closed.append(b)
        elif opened.pop() != PAIRS[b]:
            return Summary(BROKEN, "", "", "")
    return Summary(state, "".join(closed), "".join(opened), stream)


def state_map(language: str, chunk: str, first: bool) -> dict[str, Summary]:
    """The lexer-state map of a chunk of whole lines; the first chunk of a file is entered in code only.

    Where what was open at the entry ends on a token's edge, the rest is the same stream as from the start in code.
    """
    classes, find = _CLASSES[language], _TILES[language].findall
    if first and language in ("py", "js") and chunk[:1] == "﻿":
        chunk = chunk[1:]
    chunk = "\n" + chunk
    tiles = find(chunk)
    each = [classes[t] for t in tiles]
    out = {CODE: _summed("".join(each))}
    if language == "py" and "\0" in chunk:
        out = {CODE: Summary(BROKEN, "", "", "")}
    edges = None
    for entry in () if first else _STATES[language][1:]:
        m = _ENDS[entry][language].match(chunk)
        if not m:
            out[entry] = Summary(entry, "", "", "\n" if language == "js" and entry == COMMENT else "")
            continue
        head = ("\n" if language == "js" else "") if entry == COMMENT else "s" if language == "py" else "n"
        if edges is None:
            edges = {at: k for k, at in enumerate(accumulate(map(len, tiles), initial=0))}
        k = edges.get(m.end())
        rest = each[k:] if k is not None else [classes[t] for t in find(chunk, m.end())]
        out[entry] = _summed(head + "".join(rest))
    return out


def joined(a: Summary, b: dict[str, Summary]) -> Summary:
    """A chunk's summary followed by the next chunk's map; associative."""
    if a.state == BROKEN or a.state not in b:
        return Summary(BROKEN, "", "", "")
    n = b[a.state]
    opened, closed = a.opened, n.closed
    k = min(len(opened), len(closed))
    if any(PAIRS[c] != o for c, o in zip(closed[:k], reversed(opened[len(opened) - k:]))):
        return Summary(BROKEN, "", "", "")
    return Summary(n.state, a.closed + closed[k:], opened[:len(opened) - k] + n.opened, a.stream + n.stream)


def stream(language: str, text: str) -> str | None:
    """The stream of a whole text, or None where literals, comments or brackets are not closed."""
    s = state_map(language, text, True)[CODE]
    return s.stream if s[:3] == (CODE, "", "") else None

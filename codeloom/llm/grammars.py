"""Local grammars: each balanced bracket group of a class stream is checked by itself and then stands for one symbol.

A group's classes, nested groups reduced, have to match the regular expressions of its language.  Groups are closed from
the inside out, so a pattern never has to count brackets; what belongs together across the statements of a block (an
else and its if, a catch and its try, the while of a do, Python's indentation) is bound by a small stack.

Symbols of reduced groups: p/P empty/filled parentheses, B brackets, C braces that form a block, o operand in braces,
A an arrow function's body; in Python p/P, E/B empty/filled brackets and O braces.  The classes of tokens are listed in
:mod:`codeloom.llm.lexing`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from codeloom.llm import lexing

_SPLIT = re.compile(r"([()\[\]{}])")
#: Groups up to this length are remembered with their verdict.
_SHORT = 400


class _Frame:
    __slots__ = ("bracket", "role", "parts", "inside", "ended")

    def __init__(self, bracket: str, role: str, inside: bool = False) -> None:
        self.bracket, self.role, self.parts = bracket, role, []
        self.inside = inside  # within a function
        self.ended = False  # a semicolon was seen


def _tail(parts: list[str], reach: int = 400) -> str:
    """The classes since the last semicolon or block."""
    out = ""
    for p in reversed(parts):
        k = max(p.rfind(";"), p.rfind("C"))
        if k >= 0:
            return p[k + 1:] + out
        out = p + out
        if len(out) > reach:
            break
    return out


def _remembered(check: Callable) -> Callable:
    """``check`` with its verdicts on short strings remembered."""
    short = functools.lru_cache(1 << 16)(check)
    return lambda *a: short(*a) if len(a[-1]) <= _SHORT else check(*a)


def _pieces(s: str) -> list[str]:
    """Statements of a block: each ends with a semicolon or a block that no operand continues."""
    return re.findall(r"[^;C]*[;C]|[^;C]+$", s)


def _bound(pieces: list[str], read: Callable) -> bool:
    """Whether all pieces are statements and every else, catch, finally and while finds what it belongs to.

    ``read`` gives (fresh, lead, core) of a piece or None: ``fresh`` tells of labels before it, ``lead`` lists I, E, W, F, D
    and L for what a statement is the body of, ``core`` is try, resources, catch, finally, while or other.
    """
    chain: list[str] = []
    for p in pieces:
        parsed = read(p)
        if parsed is None:
            return False
        fresh, lead, core = parsed
        if lead and lead[0] == "W" and "D" in chain and not fresh:  # the line end after a do's while ends its statement
            while chain[-1] in "IEWFLy":
                chain.pop()
            if chain.pop() != "D":
                return False
            lead, chain = lead[1:], []
        if lead and lead[0] == "E" and not fresh:
            while chain and chain[-1] in "EWFLy":
                chain.pop()
            if not chain or chain.pop() != "I":
                return False
            chain = chain + list(lead)
        elif core in ("catch", "finally") and not lead and not fresh:
            if not chain or chain.pop() not in "Yy":
                return False
            if core == "catch":
                chain.append("y")
            continue
        elif core == "while" and not fresh and "D" in chain:
            while chain[-1] in "IEWFLy":
                chain.pop()
            if chain.pop() != "D":
                return False
            continue
        else:
            if "D" in chain or "Y" in chain or core in ("catch", "finally") or "E" in lead:
                return False
            chain = list(lead)
        if "E" in lead[1:]:
            return False
        if core == "while":
            chain.append("W")
        elif core == "try":
            chain.append("Y")
        elif core == "resources":
            chain.append("y")
    return "D" not in chain and "Y" not in chain


# --- Java -----------------------------------------------------------------------------------------------------------
_T = r"[it](?:\.i)*B*"
_TS = rf"{_T}(?:,{_T})*"
_POST = r"(?:\.N?i|[pP]|B|u|Mi|MN|\.n)"
_OPD = rf"(?:N{_T}(?:[pP]o?|o)?|(?:i|n|P|o|t(?=[.BM]))|pL[io n])"
_UNARY = r"(?:[!+u]|P(?=[iNnPpo!]))*"
_UNIT = rf"{_UNARY}{_OPD}{_POST}*"
# What is assigned to is a name, a field or an element.
_X = rf"(?:{_UNIT}(?:(?:(?:>{{1,3}}|[b+<?:L]|(?<=[iB])=){_UNARY}{_OPD}{_POST}*)|Om*{_T}(?:i|P)?)*)"
# An expression is a statement only if it assigns, counts, calls or makes something.
_XS = rf"(?=[^;]*[=u][^;]*;|[^;]*i[pP];|N[^;]*[pPo];){_X}"
_VAR = rf"iB*(?:={_X})?(?:,iB*(?:={_X})?)*"
_DECL = rf"m*{_T}{_VAR}"
_PARAM = rf"m*{_T}~?iB*"
_LABEL = rf"(?:(?:K(?:{_X}|m*{_T}i)(?:,{_X})*|d):)*"
_TYPE = rf"m*(?:ci(?:x{_T})?(?:G{_TS})?(?:V{_TS})?C|fi(?:x{_TS})?(?:V{_TS})?C|ei(?:G{_TS})?C|ri[pP](?:G{_TS})?C)"
_JAVA_LABELS = re.compile(_LABEL)
_JAVA_ARROW = re.compile(rf"(?:K(?:{_X}|m*{_T}i)(?:,{_X})*|d|K?n,d)L")
_JAVA_ARROWED = re.compile(rf"T?{_X};|T{_X};|C")
_LEADS = re.compile(r"IP|WP|FP|E|D|i:")
_JAVA_CORE = re.compile(
    rf";|R(?:{_X})?;|T{_X};|Ji?;|A{_X}(?::{_X})?;|{_DECL};|{_XS};|C|SPC|YP?C|HPC|ZC|sPC|{_TYPE}")
_JAVA_MEMBER = re.compile(
    rf"m*(?:;|C|{_T}{_VAR};|d?{_T}i[pP]B*(?:w{_TS})?(?:C|;|d(?:{_X}|n);)|i[pP](?:w{_TS})?C|iC)|{_TYPE}|[dm]*{_T}i[pP](?:w{_TS})?(?:C|;)")
_JAVA_ENUM = re.compile(r"(?:i[pP]?o?(?:,i[pP]?o?)*,?)?")
_JAVA_UNIT = re.compile(rf"(?:ai(?:\.i)*;)?(?:qm?i(?:\.i)*(?:\.b)?;|;)*(?:{_TYPE}|;)*")
_JAVA_PARENS = {
    "F": re.compile(rf"(?:{_DECL}|{_X}(?:,{_X})*)?;(?:{_X})?;(?:{_X}(?:,{_X})*)?|{_PARAM}:{_X}"),
    "Y": re.compile(rf"(?:{_DECL}|{_X})(?:;(?:{_DECL}|{_X}))*;?"),
    "H": re.compile(rf"m*{_T}(?:b{_T})*i"),
    "I": re.compile(_X), "W": re.compile(_X), "S": re.compile(_X), "s": re.compile(_X),
}
_JAVA_LIST = re.compile(rf"{_X}(?:,{_X})*|{_PARAM}(?:,{_PARAM})*|{_TS}")
_JAVA_INDEX = re.compile(rf"(?:{_X})?")
_JAVA_ARRAY = re.compile(rf"(?:{_X}(?:,{_X})*,?|,)?")
_ANNOTATION = re.compile(r"@i(?:\.i)*[pP]?")
_GENERIC = re.compile(r"(?<=[im;{}(,=.NM@R<?CL])<(?:(?:m*[it](?:\.i)*B*|\?)(?:[xi][it](?:\.i)*B*(?:b[it](?:\.i)*)*)?(?:,(?:m*[it](?:\.i)*B*|\?)(?:[xi][it](?:\.i)*B*(?:b[it](?:\.i)*)*)?)*)?>"
                      r"|^<(?:i(?:x[it](?:\.i)*(?:b[it](?:\.i)*)*)?,?)+>")
#: Words that mean something in their place only.
_JAVA_PLACED = (("r", re.compile(r"r(?!i[(<])"), "i"), ("v", re.compile(r"(?<=[i>])v(?=i)"), "V"), ("v", re.compile("v"), "i"),
                ("g", re.compile(r"g(?=[mcfe@])"), "m"), ("g", re.compile("g"), "i"), ("y", re.compile(r"y(?![=.(\[]|u;)"), "R"), ("y", re.compile("y"), "i"),
                ("s", re.compile(r"s(?!\()"), "m"), (".", re.compile(r"(?<=\.)c"), "i"), ("@", re.compile("@f"), "f"))


def _java_plain(s: str) -> str:
    """Classes without annotations and type arguments."""
    if "@" in s:
        s = _ANNOTATION.sub("", s)
    while "<" in s:
        t = _GENERIC.sub("", s)
        if t == s:
            break
        s = t
    return s


@_remembered
def _java_braces_role(parent: str, ended: bool, tail: str) -> str:
    """What braces that open after the classes ``tail`` hold."""
    if parent == "array":
        return "array"
    tail = _java_plain(tail)
    if re.search(r"(?:=|B|,|^|pd)$", tail) and (tail.endswith(("=", "d")) or re.search(r"N[it](?:\.i)*B+$", tail)):
        return "array"
    if re.search(r"N[it](?:\.i)*[pP]$", tail):
        return "anonymous"
    if tail.endswith("L"):
        return "lambda" if not re.match(r"(?:K|d)", tail) else "block"
    if tail.endswith("SP"):
        return "switched" if re.search(r"[=(,R?:Lb+]SP$", tail) or parent == "(" else "switch"
    if re.search(r"ei(?:G.*)?$", tail):
        return "enum"
    if re.search(r"[cf]i(?:[xGV].*)?$", tail) or re.search(r"ri[pP](?:G.*)?$", tail):
        return "class"
    if parent == "enum" and not ended and re.search(r"(?:^|,)i[pP]?$", tail):
        return "anonymous"
    return "block"


@_remembered
def _java_piece(s: str) -> tuple | None:
    """A statement of a Java block for :func:`_bound`."""
    labels = _JAVA_LABELS.match(s).end()
    rest = s[labels:]
    if labels and not rest:
        return True, (), "other"
    if arrow := _JAVA_ARROW.match(rest):
        return (True, (), "other") if not labels and _JAVA_ARROWED.fullmatch(rest, arrow.end()) else None
    return _led(labels > 0, rest, _JAVA_CORE)


def _led(fresh: bool, rest: str, core: re.Pattern) -> tuple | None:
    lead = []
    while m := _LEADS.match(rest):
        if m[0] == "WP" and rest == "WP;":
            break
        lead.append("L" if m[0] == "i:" else m[0][0])
        rest = rest[m.end():]
    if rest == "WP;":
        return fresh, tuple(lead), "while"
    if not core.fullmatch(rest):
        return None
    kind = {"Y": "resources" if rest[:2] == "YP" else "try", "H": "catch", "Z": "finally"}.get(rest[0], "other")
    return fresh, tuple(lead), kind


def _java_switch(pieces: list[str]) -> bool:
    """Whether a switch's body begins with a label and has labels of one kind."""
    cases = [p for p in pieces if p[0] in "Kd" or p.startswith("n,dL")]
    arrows = [p for p in cases if _JAVA_ARROW.match(p)]
    return not pieces or pieces[0] in cases and len(arrows) in (0, len(cases)) and (not arrows or len(arrows) == len(pieces))


@_remembered
def _java_group(role: str, s: str) -> bool:
    s = _java_plain(s)
    if role == "array":
        return bool(_JAVA_ARRAY.fullmatch(s))
    if role in ("class", "anonymous", "enum"):
        s = re.sub(r"(?<![pPB])d(?![:L])", "m", s) if "d" in s else s
        if role == "enum":
            head, _, s = s.partition(";")
            if not _JAVA_ENUM.fullmatch(head):
                return False
        return all(map(_JAVA_MEMBER.fullmatch, _pieces(s)))
    pieces = _pieces(s)
    if role in ("switch", "switched"):
        return _java_switch(pieces) and _bound(pieces, _java_piece)
    if any(p[0] in "Kd" for p in pieces):
        return False  # a case outside of a switch
    return _bound(pieces, _java_piece)


@_remembered
def _java_parens(role: str, s: str) -> bool:
    s = _java_plain(s)
    return bool(_JAVA_PARENS.get(role, _JAVA_LIST).fullmatch(s)) if s else not role


@_remembered
def _java_index(s: str) -> bool:
    return bool(_JAVA_INDEX.fullmatch(_java_plain(s)))


def java_parses(stream: str) -> bool:
    """Whether a balanced stream is a compilation unit of Java 17; names and types need not resolve."""
    for letter, pattern, to in _JAVA_PLACED:
        if letter in stream:
            stream = pattern.sub(to, stream)
    if "X" in stream or "#" in stream:
        return False
    stack = [_Frame("", "unit")]
    for part in _SPLIT.split(stream):
        top = stack[-1]
        if part == "{":
            stack.append(_Frame(part, _java_braces_role(top.role or top.bracket, top.ended, _tail(top.parts))))
        elif part == "(":
            last = top.parts[-1][-1] if top.parts else ""
            stack.append(_Frame(part, last if last and last in "FYHIWSs" else ""))
        elif part == "[":
            stack.append(_Frame(part, ""))
        elif part in (")", "]", "}") and part:
            frame, s = stack.pop(), "".join(top.parts)
            up = stack[-1].parts
            if part == ")":
                if not _java_parens(frame.role, s):
                    return False
                up.append("P" if s else "p")
            elif part == "]":
                if not _java_index(s):
                    return False
                up.append("B")
            else:
                if not _java_group(frame.role, s):
                    return False
                if frame.role == "switched":
                    joined = "".join(up[-3:])
                    up[-3:] = [joined[:-2] + "n"] if joined.endswith("SP") else [joined, "X"]
                else:
                    up.append({"lambda": "n", "array": "o", "anonymous": "o"}.get(frame.role, "C"))
        elif part:
            top.parts.append(part)
            top.ended = top.ended or ";" in part
    return bool(_JAVA_UNIT.fullmatch(_java_plain("".join(stack[0].parts))))


# --- JavaScript -----------------------------------------------------------------------------------------------------
_JPOST = r"(?:\.[a-zA-Z#]|[pP]|B|u)"
_JOPD = r"(?:i|n|P|B|o|q(?=[pP])|!(?=\.))"
_JUNIT = rf"(?:G?[!+u~]*{_JOPD}{_JPOST}*|G)"
_JPART = rf"(?:[ipP]L)*(?:A|{_JUNIT}(?:[b+<>]{_JUNIT})*)"
_JX = rf"(?:{_JPART}(?:(?:[?:]|(?<=[iBo])=){_JPART})*)"
_JXS = rf"{_JX}(?:,{_JX})*"
_JVAR = rf"(?:v(?:i|[Bo](?==))(?:={_JX})?(?:,(?:i|[Bo](?==))(?:={_JX})?)*|k[iBo]={_JX}(?:,[iBo]={_JX})*)"
_JS_LABELS = re.compile(rf"(?:(?:K{_JXS}|d):)*")
_JS_CORE = re.compile(
    rf";|R(?:{_JXS})?;|T{_JXS};|Ji?;|{_JVAR};|{_JXS};|C|SPC|YC|HP?C|ZC|fi[pP]C|ci(?:x{_JX})?C|q.*;"
    rf"|ed?(?:{_JVAR};|{_JXS};|fi?[pP]C|ci?(?:x{_JX})?C|o(?:in)?;|b(?:ii)?in;)")
_JS_PARENS = {
    "F": re.compile(rf"(?:{_JVAR}|{_JXS})?;(?:{_JXS})?;(?:{_JXS})?|(?:[vk][iBo]|{_JUNIT})(?:b|O){_JX}"),
    "H": re.compile(r"[iBo]"), "I": re.compile(_JXS), "W": re.compile(_JXS), "S": re.compile(_JXS),
}
_JS_LIST = re.compile(rf"(?:{_JXS}),?")
_JS_ARRAY = re.compile(rf"(?:(?:{_JX})?,)*(?:{_JX})?")
_KEY = r"(?:[a-zA-Z#!]|B)"
_JS_OBJECT = re.compile(
    rf"(?:(?:{_KEY}:{_JX}|~{_JX}|i(?:={_JX})?|[nvyg]|(?:[gy]*b?){_KEY}[pP]C)(?:,|$))*")
_JS_NAMES = re.compile(r"(?:[a-zA-Z](?:i[a-zA-Z])?,)*(?:[a-zA-Z](?:i[a-zA-Z])?)?")
_JS_MEMBER = re.compile(rf"(?:[gy]*b?{_KEY}[pP]C|[gy]*{_KEY}(?:={_JX})?;|[gi]C|;)")
_JS_ENDS = "[inpPBouJAR`]"
_JS_STARTS = "[invkfcIWFDSRTJYqe!KdEygGCu~]"
_JS_LINE = re.compile(rf"(?<={_JS_ENDS})\n+(?={_JS_STARTS})")
_JS_BODY = ("block", "function", "arrow", "method", "class", "switch")
_JS_ASYNC = re.compile(r"y(?=\n*(?:f|iL|[pP]L))")


@_remembered
def _js_lines(role: str, s: str) -> str:
    """Classes with the semicolons that line ends stand for, and templates as operands or calls."""
    if "`" in s:
        s = re.sub(r"(?<=[ipPB])`", "p", s).replace("`", "n")
    if "y" in s:
        s = _JS_ASYNC.sub("", s)
    if role not in ("object", "class"):
        s = re.sub(r"[yg]", "i", s)
    if "O" in s and role != "F":
        s = s.replace("O", "i")
    if "\n" in s:
        if role in _JS_BODY:
            # A body follows its head on whatever line.
            s = _JS_LINE.sub(lambda m: "\n" if s[m.end()] == "C" and s[m.start() - 1] in "pP" or re.search("[IWF]!?P$", s[max(0, m.start() - 3):m.start()]) else ";", s)
        s = s.replace("\n", "")
    return s.replace("fb", "f").replace("F!", "F")


@_remembered
def _js_braces_role(parent: str, inside: str, tail: str) -> str:
    tail = re.split(r"[;C]", _js_lines(parent if parent in _JS_BODY else "block", tail))[-1]
    if parent == "block" and re.fullmatch(r"q(?:i,)?|e", tail):
        return "names"
    if re.search(r"ci?(?:x.*)?$", tail):
        return "class"
    if re.search(r"f\*?b?i?[pP]$", tail):
        return "function"
    if tail.endswith("L"):
        return "arrow"
    if parent in ("object", "class") and re.search(r"(?:^|,|[a-zA-Z#!]|B)[pP]$", tail):
        return "method"
    if tail == "SP" or re.search(r"(?:^|:)SP$", tail):
        return "switch"
    if parent in ("(", "[", "object") or re.search(r"(?:[=(,?b+<>!~RTG]|[vk]|^q|^e|^ed|[^K].*:)$", tail) and not re.fullmatch(r"(?:[^?]*K[^?]*|d|i):", tail):
        return "object"
    return "block"


@_remembered
def _js_piece(s: str) -> tuple | None:
    labels = _JS_LABELS.match(s).end()
    rest = s[labels:]
    if labels and not rest:
        return True, (), "other"
    # A colon belongs to a question mark, a case, a default or a label.
    if ":" in s and s.count(":") > s.count("?") + s.count("K") + s.count("d:") + len(re.findall(r"(?:^|[:PDE])i(?=:)", s)):
        return None
    return _led(labels > 0, rest, _JS_CORE)


@_remembered
def _js_group(role: str, inside: bool, s: str) -> bool:
    if role in ("object", "names"):
        return bool((_JS_OBJECT if role == "object" else _JS_NAMES).fullmatch(_js_lines(role, s)))
    s = _js_lines(role, s)
    if s and s[-1] not in ";C":
        s += ";"
    pieces = _pieces(s)
    if role == "class":
        return all(map(_JS_MEMBER.fullmatch, pieces))
    if not inside and "R" in s:
        return False  # a return outside of a function
    if role != "switch" and any(_JS_LABELS.match(p).end() for p in pieces):
        return False
    return _bound(pieces, _js_piece)


@_remembered
def _js_parens(role: str, s: str) -> bool:
    s = _js_lines(role, s)
    return bool(_JS_PARENS.get(role, _JS_LIST).fullmatch(s)) if s else role not in _JS_PARENS


@_remembered
def _js_index(s: str) -> bool:
    return bool(_JS_ARRAY.fullmatch(_js_lines("[", s)))


def js_parses(stream: str) -> bool:
    """Whether a balanced stream is an ECMAScript script or module."""
    if "X" in stream or "#" in stream:
        return False
    stream = re.sub(r"\.\n*[a-zA-Z!]", ".i", stream)
    stack = [_Frame("", "block")]
    for part in _SPLIT.split(stream):
        top = stack[-1]
        if part == "{":
            role = _js_braces_role(top.role, "", _tail(top.parts))
            stack.append(_Frame(part, role, top.inside or role in ("function", "arrow", "method")))
        elif part == "(":
            last = top.parts[-1].rstrip("\n") if top.parts else ""
            role = "F" if last.endswith("F!") else last[-1:] if last and last[-1] in "FHIWS" else "("
            stack.append(_Frame(part, role, top.inside))
        elif part == "[":
            stack.append(_Frame(part, "[", top.inside))
        elif part and part in ")]}":
            frame, s = stack.pop(), "".join(top.parts)
            up = stack[-1].parts
            if part == ")":
                if not _js_parens(frame.role, s):
                    return False
                up.append("P" if s.strip("\n") else "p")
            elif part == "]":
                if not _js_index(s):
                    return False
                up.append("B")
            elif not _js_group(frame.role, frame.inside, s):
                return False
            else:
                before = _tail(up)
                up.append({"object": "o", "arrow": "A", "names": "o"}.get(frame.role, "C"))
                if frame.role in ("function", "class"):
                    _as_operand(stack[-1], before)
        elif part:
            top.parts.append(part)
    return _js_group("block", False, "".join(stack[0].parts))


_HEAD = re.compile(r"(?:f\*?b?i?[pP]|ci?(?:x[^;C]*)?)$")


def _as_operand(frame: _Frame, before: str) -> None:
    """Replace the head and the body of a function or class by one operand where it is no declaration."""
    up = frame.parts
    plain = before.replace("\n", "")
    head = _HEAD.search(plain)
    start = head.start() if head else len(plain)
    lead = _js_lines("block", before[:max(0, len(before) - (len(plain) - start))]) if "\n" in before else plain[:start]
    lead = lead.rstrip("y")
    starts_line = "\n" in before and re.search(rf"{_JS_ENDS}\n+y?$", before[:_position(before, start)])
    if frame.role in ("(", "[", "object") or lead and lead[-1] not in ";C:E" and not re.search(r"(?:^|;)ed?$", lead) and not starts_line:
        tail_length = len(before) - _position(before, start)
        text = "".join(up)
        up[:] = [text[:len(text) - 1 - tail_length].rstrip("\n").removesuffix("y") if lead != plain[:start] else text[:len(text) - 1 - tail_length], "o"]


def _position(s: str, k: int) -> int:
    """Where the ``k``-th class of ``s`` that is no line end stands."""
    for at, c in enumerate(s):
        if c != "\n":
            if k == 0:
                return at
            k -= 1
    return len(s)


# --- Python ---------------------------------------------------------------------------------------------------------
_NM = "[imku]"
_ATOM = "(?:[imkun]|s+|[pPBEO])"
_PPOST = rf"(?:\.{_NM}|[pP]|B)"
_U = rf"[!+]*{_ATOM}{_PPOST}*"
_C = rf"{_U}(?:[b+*^a@]{_U})*"
_D = rf"h*{_C}(?:oh*{_C})*"
_LPAR = rf"(?:[*^]{_NM}|{_NM}(?:={_D})?|[*b])"
_LAM = rf"L(?:{_LPAR}(?:,{_LPAR})*,?)?:"
_PX = rf"(?:{_LAM})*{_D}(?:f{_D}e(?:{_LAM})*{_D})*"
_PXN = rf"(?:{_NM}V)?{_PX}"
_SX = rf"(?:\*{_D}|{_PX})"
_PXS = rf"{_SX}(?:,{_SX})*,?"
_SXN = rf"(?:\*{_D}|{_PXN})"
_SXNS = rf"{_SXN}(?:,{_SXN})*,?"
_YX = rf"Y(?:Q{_PX}|{_PXS})?"
_RHS = rf"(?:{_PXS}|{_YX})"
_PLACE = rf"(?:{_ATOM}{_PPOST}*(?:\.{_NM}|B)|{_NM})"
_TT = rf"\*?(?:{_PLACE}|[PpBE])"
_TL = rf"{_TT}(?:,{_TT})*,?"
_COMP = rf"(?:z?r{_TL}a{_D}(?:f(?:{_NM}V)?{_D})*)+"
_ITEM = rf"{_PX}(?:A{_TT})?"
_PA, _KA = rf"(?:\*{_PX}|{_PXN})", rf"(?:{_NM}={_PX}|[*^]{_PX})"
_IMPORTED = rf"{_NM}(?:A{_NM})?(?:,{_NM}(?:A{_NM})?)*"
_PPAR = rf"(?:{_NM}(?::{_PX})?(?:={_PX})?|\*(?:{_NM}(?::\*?{_PX})?)?|\^{_NM}(?::{_PX})?|b)"
_KV = rf"(?:{_PX}:{_PX}|\^{_D})"
_SLICE = rf"(?:(?:{_PX})?:(?:{_PX})?(?::(?:{_PX})?)?|{_PXN}|\*{_D})"
_PY_GROUPS = {
    "group": re.compile(rf"{_SXNS}|{_YX}|{_PXN}{_COMP}"),
    "call": re.compile(rf"(?:{_PA}(?:,{_PA})*(?:,{_KA}(?:,{_KA})*)?|{_KA}(?:,{_KA})*),?|{_PXN}{_COMP}|{_YX}"),
    "parameters": re.compile(rf"{_PPAR}(?:,{_PPAR})*,?"),
    "names": re.compile(rf"{_IMPORTED},?"),
    "items": re.compile(rf"{_ITEM}(?:,{_ITEM})*,?|{_SXNS}"),
    "index": re.compile(rf"{_SLICE}(?:,{_SLICE})*,?"),
    "list": re.compile(rf"{_SXNS}|{_PXN}{_COMP}"),
    "braces": re.compile(rf"{_KV}(?:,{_KV})*,?|{_PX}:{_PX}{_COMP}|{_SXNS}|{_PXN}{_COMP}"),
}
_SIMPLE = re.compile(
    rf"{_PXS}|(?:{_TL}=)+{_RHS}|{_PLACE}~{_RHS}|(?:{_PLACE}|P):{_PX}(?:={_RHS})?|{_YX}|R(?:{_PXS})?|T(?:{_PX}(?:Q{_PX})?)?|K|g{_NM}(?:,{_NM})*|D{_TL}"
    rf"|S{_PX}(?:,{_PX})?|q{_NM}(?:\.{_NM})*(?:A{_NM})?(?:,{_NM}(?:\.{_NM})*(?:A{_NM})?)*|Q(?:[.n]+(?:{_NM}(?:\.{_NM})*)?|{_NM}(?:\.{_NM})*)q(?:\*|{_IMPORTED}|P)|u{_NM}B?={_PX}")
_PY_HEAD = re.compile(
    rf"(?:f{_PXN}|l{_PXN}|w{_PXN}|e|z?r{_TL}a{_PXS}|t|x(?:\*?{_PX}(?:A{_NM})?)?|y|z?W{_ITEM}(?:,{_ITEM})*|z?d{_NM}B?[pP](?:>{_PX})?|c{_NM}B?[pP]?|m{_PXS}|k.+?):")
_PY_KINDS = {"f": "if", "l": "elif", "w": "loop", "r": "loop", "e": "else", "t": "try", "x": "except", "y": "finally", "W": "with", "d": "def", "c": "def", "m": "match", "k": "case"}
#: What may follow a statement of a kind at its own indentation.
_PY_FOLLOWS = {"elif": ("if", "elif"), "else": ("if", "elif", "loop", "except"), "except": ("try", "except"), "finally": ("try", "except", "tried")}
_MARKS = re.compile(f"[{chr(lexing.INDENT)}-{chr(lexing.INDENT + lexing.WIDEST)}]")


def _py_plain(s: str) -> str:
    return s.replace("ha", "b").replace("jh", "b").replace("j", "b")


@_remembered
def _py_group(kind: str, s: str) -> bool:
    s = _py_plain(s)
    if not _PY_GROUPS[kind].fullmatch(s):
        return False
    if kind == "parameters":
        given = False
        for p in s.split(","):
            if p[:1] in ("*", "^", "L") or "L" in s:
                break
            if p and p != "b":
                if given and "=" not in p:
                    return False  # a parameter without a default after one that has it
                given = "=" in p
    return True


@_remembered
def _py_line(s: str) -> tuple[str, bool] | None:
    """(kind, whether a block follows) of a logical line."""
    s = _py_plain(s)
    if s[0] == "@":
        return ("decorator", False) if re.fullmatch(_PXN, s[1:]) else None
    if all(_SIMPLE.fullmatch(x) for x in (s[:-1] if s[-1] == ";" else s).split(";")):
        return "simple", False
    m = _PY_HEAD.match(s)
    if not m:
        return None
    kind = _PY_KINDS[s[1] if s[0] == "z" else s[0]]
    rest = s[m.end():]
    if not rest:
        return kind, True
    if kind == "match" or not all(_SIMPLE.fullmatch(x) for x in (rest[:-1] if rest[-1] == ";" else rest).split(";")):
        return None
    return kind, False


def _py_blocks(lines: list[tuple[int, str]]) -> bool:
    """Whether logical lines with their indentation form blocks."""
    levels: list[list] = [[0, "", ""]]  # indentation, kind of the last statement, kind of the block
    wanted = ""
    for width, s in lines:
        told = _py_line(s)
        if told is None:
            return False
        kind, opens = told
        if wanted:
            if width <= levels[-1][0]:
                return False
            levels.append([width, "", wanted])
        elif width > levels[-1][0]:
            return False
        while width < levels[-1][0]:
            if levels.pop()[1] in ("try", "decorator"):
                return False
        here = levels[-1]
        if width != here[0]:
            return False
        before = here[1]
        if kind in _PY_FOLLOWS:
            if before not in _PY_FOLLOWS[kind]:
                return False
            if kind == "else":
                kind = "tried" if before == "except" else "done"
        elif before == "try" or before == "decorator" and kind not in ("def", "decorator"):
            return False
        if (here[2] == "match") != (kind == "case"):
            return False
        here[1] = kind
        wanted = told[0] if opens else ""
    return not wanted and not any(x[1] in ("try", "decorator") for x in levels)


def py_parses(stream: str) -> bool:
    """Whether a balanced stream is a Python 3 module."""
    if "X" in stream:
        return False
    stack = [_Frame("", "module")]
    for part in _SPLIT.split(stream):
        top = stack[-1]
        if part and part in "([{":
            before = "".join(top.parts[-2:])
            last = before[-1:]
            after = last != "" and last in "imkunsPpBEO"
            if part == "(":
                role = ("parameters" if re.search(rf"d{_NM}B?$", before) or re.search(rf"d{_NM}B?$", "".join(top.parts[-4:])) else "call") if after else {
                    "q": "names", "W": "items"}.get(last, "group")
            else:
                role = "braces" if part == "{" else "index" if after else "list"
            stack.append(_Frame(part, role))
        elif part and part in ")]}":
            frame, s = stack.pop(), "".join(top.parts)
            if s and not _py_group(frame.role, s) or not s and frame.role in ("index", "names"):
                return False
            stack[-1].parts.append("O" if part == "}" else ("B" if s else "E") if part == "]" else "P" if s else "p")
        elif part:
            top.parts.append(_MARKS.sub("", part) if len(stack) > 1 else part)
    lines, width, at = [], 0, 0
    text = "".join(stack[0].parts)
    for m in _MARKS.finditer(text):
        if m.start() > at:
            lines.append((width, text[at:m.start()]))
        width, at = ord(m[0]) - lexing.INDENT, m.end()
    if at < len(text):
        lines.append((width, text[at:]))
    return _py_blocks(lines)


# --- JSON -----------------------------------------------------------------------------------------------------------
_JSON_GROUPS = {"{": re.compile(r"(?:s:[snOB](?:,s:[snOB])*)?"), "[": re.compile(r"(?:[snOB](?:,[snOB])*)?")}


@_remembered
def _json_group(bracket: str, s: str) -> bool:
    return bool(_JSON_GROUPS[bracket].fullmatch(s))


def json_parses(stream: str) -> bool:
    """Whether a balanced stream is one JSON value."""
    if "(" in stream:
        return False
    stack: list[list[str]] = [[]]
    for part in _SPLIT.split(stream):
        if part in ("{", "["):
            stack.append([])
        elif part in ("}", "]"):
            s = "".join(stack.pop())
            if not _json_group("{" if part == "}" else "[", s):
                return False
            stack[-1].append("O" if part == "}" else "B")
        elif part:
            stack[-1].append(part)
    return "".join(stack[0]) in ("s", "n", "O", "B")


PARSES = {"java": java_parses, "js": js_parses, "py": py_parses, "json": json_parses}


def valid(language: str, text: str) -> bool:
    """Whether a whole text is valid in a language."""
    stream = lexing.stream(language, text)
    return stream is not None and PARSES[language](stream)

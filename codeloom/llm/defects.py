"""Broken prompt and response pairs: labelling functions combined by an expectation-maximization label model.

The prompt is a method's source, the response its conversion.  For every sign of a defect some noisy labelling functions vote
1 (defect), 0 (none) or -1 (abstain); each looks at something else.  A two-class model with one accuracy table per function is
fitted by EM over the counts of vote patterns; there are at most ``3 ** functions`` patterns, whatever the number of rows.
Cutoffs are validated on pairs with known labels: a bounded sample is damaged on purpose (:func:`damaged`).
"""

from __future__ import annotations

import ast
import keyword
import math
import random
import re
import textwrap
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import written

# Signs of each defect and language, in natural order.
_DECLINE = re.compile(
    r"(?i)\b(?:must|have to|need to|i) (?:decline|refuse|pass on)|have to pass\b|\bI(?:'d| would) rather not\b"
    r"|\b(?:can ?not|can't|won't|will not|(?:un|not )able to|not (?:feel )?comfortable)\W+(?:be |to )?(?:help\w* (?:with )?)?"
    r"(?:convert|translat|port|rewrit|moderni[sz]|reproduc|provid|assist|help|answer|comply|do this|complete|fulfil|share)\w*"
    r"|against (?:the|my) (?:terms|rules|guidelines|policy)|falls outside what|outside (?:of )?my (?:scope|remit)"
    r"|inappropriate for me|no answer can be|will not be (?:given|provided)|no \w+ code is provided")
_GROUND = re.compile(
    r"(?i)my guidelines|terms I work under|looks? confidential|could be misused|may belong to someone|no licen[cs]e was shown"
    r"|touches \w+ payments|as an? (?:ai|assistant|language model)|have a developer look|ask the \w+ owners|will stop here"
    r"|have left them alone|something I have to pass")
_JOB = re.compile(r"(?i)\b(?:convert|translat|port|rewrit|moderni[sz]|reproduc)\w*|\b(?:request|answer|code|version|method|function|routine|rules|logic)\b")
_SPEAKER = re.compile(r"\b(?:I|I'm|I'd|[Mm]e|[Mm]y|[Ww]e|[Oo]ur)\b")
_NO = re.compile(r"(?i)\b(?:not|no|nothing|never|cannot|rather|sooner|sorry|unwilling|beyond|refuse|decline|instead)\b|n't\b")
_DOUBT = re.compile(r"(?i)unable to (?:tell|say|see|know|determine)|could not (?:see|tell|determine)|not sure|assumed")
_FAILURE = re.compile(
    r"(?i)^\W*(?:error\b|exception\b|traceback|(?:llm |api )?(?:call|request) failed|failed|timed? ?out|n/?a\b|none\b|null\b|nil\b|todo\b|tbd\b"
    r"|no (?:code|output|result|answer)\b|not (?:available|implemented|converted)|placeholder|conversion failed|empty\b|see above)")
_FOREIGN_CODE = re.compile(
    r"(?m)^\s*(?:func\s+\w+\s*\(|fn\s+\w+\s*[(<]|fun\s+\w+\s*\(|sub\s+\w+\s*\{|(?:export\s+)?(?:async\s+)?function\s+\w+\s*\(|const\s+\w+\s*=|let\s+(?:mut\s+)?\w+"
    r"|local\s+function|end\s*$|\$\w+\s*=|<\?php|#include|package\s+\w+|import\s+\w+(?:\.\w+)+;|using\s+\w+|namespace\s+\w+"
    r"|(?:public|private|protected|static|internal|override)\s+[\w<>\[\], ]+\(|(?:int|void|double|long|bool|boolean|string|String|var)\s+\w+\s*[(=]"
    r"|def\s+\w+\([^)]*\)\s*$|def\s+\w+\([^)]*\)\s*(?::\s*\w+\s*)?=\s*\{?\s*$|CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)|Sub\s+\w+|begin\s*$)")
_LANGUAGES = {
    "en": "the a an of and to is are was were in on for with that this it as be by has have had its not from which will would should may so only now into because no or but at than their each were after before can cannot there when be been then",
    "de": "der die das den dem des ein eine einer und ist sind wurde werden mit auf für von nicht im zu bleibt nun bitte über wie auch sich bei aus nach noch nur",
    "fr": "le la les un une des du et est sont dans pour sur avec avoir été qui que pas au aux ne ce cette devient reste selon plus ont à",
    "es": "el la los las un una unos y es son en para con por que no se del al está lo más como pasa sigue siguen ahora han fue este esta",
    "pt": "o a os as um uma e é são em para com por que não se do da dos das no na foi foram ao mais como agora estão seguem",
    "nl": "de het een en is zijn in op voor met van niet dat die deze te bij blijft nu uit ook wordt werd geworden over dit aan volgen",
    "pl": "i w z na do nie jest są się że po od dla przez oraz to jak tylko teraz został została pozostał bez proszę",
    "it": "il lo la gli le un una e è sono in per con che non si del della dei al ora sono stato stati rimane come più questo",
    "sv": "och att det som en ett är av för på med inte den till har om nu eller från kan",
}
_TONGUES = {w: tuple(k for k, v in _LANGUAGES.items() if w in v.split()) for line in _LANGUAGES.values() for w in line.split()}
_QUOTED = re.compile(r"(['\"`]).*?\1")
_LETTERS = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"^\s*```[ \t]*(\w*)[ \t]*\n?(.*?)(?:\n?```\s*|)$", re.S)
_JAVA_TRIVIA = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_PYTHON_HEAD = re.compile(r"(?:#|@|async def|def|class|import|from|\"\"\"|''')")
_OTHER_LINE = re.compile(r"^\s*end\s*$|[{;]\s*$", re.M)
_CLAUSE = re.compile(r"(?<=[.!?;])\s+|\n")
_DEF = re.compile(r"\s*(?:#[^\n]*\s+)*(?:@\w+[^\n]*\s+)*(?:async )?(?:def|class)\b")
_REMARK = re.compile(r"#\s*[^\W\d]+(?:\W+[^\W\d]+){5,}")
_BRACES_OR_DEF = re.compile(r"[{}=();]|^\s*(?:def|class)\b", re.M)
_COMMENT = re.compile(r"#[^\n]*")
_OPEN_END = re.compile(
    r"(?i)\b(?:the|a|an|of|and|or|to|with|that|which|because|so|by|for|from|in|on|at|as|its|into|than|but|if|when"
    r"|(?:which|that|it|there|this) (?:is|was|are|has))$")
_JAVA_ONLY = re.compile(r"\b(?:public|private|protected|final|void|new|throw|throws|static|String|int|long|double|boolean|char|extends|implements)\b(?=[ \t]+[\w(])|\b(?:null|true|false)\b|&&|\|\|")
_PYTHON_MARKS = re.compile(r"^\s*(?:(?:async )?def|class|if|elif|for|while|with|try|except|else)\b[^\n{]*:\s*(?:#[^\n]*)?$|^\s*(?:import|from)\s+[\w.]+[^;\n]*$|^\s*(?:return|raise)\b[^;\n]*$|\b(?:self|None|True|False|elif|lambda)\b", re.M)
_JAVA_NOISE = frozenset("return int long double string boolean void new this default case break throw math final var char public private".split())

DEFECTS = ("refusal", "copy", "empty", "language", "truncated")
#: Signs by which a defect shows, and the labelling functions of each, in the order of their votes.
FUNCTIONS = {
    "refusal": ("declines_job", "names_ground", "prose_for_code", "nothing_delivered", "speaker_says_no"),
    "empty": ("no_statement", "no_line", "failure_notice", "few_words"),
    "copy": ("statements_repeated", "java_layout", "java_words"),
    "language_text": ("foreign_prevails", "english_lacking", "foreign_signs", "words_unfamiliar"),
    "language_code": ("foreign_pattern", "fence_names_another", "not_python", "no_python_marks"),
    "truncated_text": ("mark_lacking", "last_word_open"),
    "truncated_code": ("breaks_off", "fence_open", "end_lacking", "word_cut"),
}
#: The defect that each sign tells of.
SIGN_OF = {k: k.split("_")[0] for k in FUNCTIONS}
#: A word is familiar if it stands in this share of all conversions' texts; the dictionary is bounded by COMMON_WORDS, and
#: smaller corpora than COMMON_LEAST have none.
COMMON_SHARE, COMMON_WORDS, COMMON_LEAST = 0.005, 50_000, 500
#: No cutoff lies below this posterior, whatever the labelled pairs say.
LEAST_POSTERIOR = 0.4
#: Pairs that are damaged on purpose to validate the cutoffs, about; a bound of the labelled sample.
LABELLED = 1_000
#: Where several defects exceed their cutoff, the first one counts.
ORDER = {d: i for i, d in enumerate(DEFECTS)}


def squeezed(java: str) -> str:
    """A source without comments and layout."""
    return re.sub(r"\s+", "", _JAVA_TRIVIA.sub(lambda m: "" if m.group()[0] == "/" else m.group(), java))


def _plain(code: str) -> tuple[str, str, int]:
    """Code without its fence, the fence's language, and 1 for an open fence, 0 for a closed one, -1 for none."""
    if "```" not in code:
        return code, "", -1
    m = _FENCE.match(code)
    if not m:
        return code.replace("```", ""), "", 0
    return m[2], m[1].lower(), int(code.count("```") % 2)


def _parsed(code: str) -> tuple[ast.Module | None, SyntaxError | None]:
    try:
        return ast.parse(textwrap.dedent(code).strip("\n")), None
    except SyntaxError as e:
        return None, e
    except (ValueError, RecursionError, MemoryError):
        return None, None


def _idle(node: ast.stmt) -> bool:
    """Whether a statement does nothing by itself."""
    if isinstance(node, ast.Pass):
        return True
    if isinstance(node, ast.Expr):
        v = node.value
        if isinstance(v, ast.BinOp) and isinstance(v.op, ast.Div):  # N/A
            return isinstance(v.left, ast.Name) and isinstance(v.right, ast.Name)
        return isinstance(v, (ast.Constant, ast.Name))
    if isinstance(node, ast.Raise):
        return "NotImplemented" in ast.dump(node)
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return all(map(_idle, node.body))
    return isinstance(node, (ast.Import, ast.ImportFrom))


def _lines(code: str) -> list[str]:
    """Lines of code that are no comment, docstring, mark, header or placeholder."""
    code = re.sub(r'^\s*[rRuU]?("""|\'\'\').*?(?:\1|\Z)', "", code, flags=re.S | re.M)
    out = []
    for line in code.split("\n"):
        line = re.sub(r"(?:#|//).*", "", line).strip()
        if re.search(r"\w", line) and not re.fullmatch(r"(?:async )?(?:def|class)\b.*|@.*|pass|N/?A|None|null|raise NotImplemented\w*(?:\(.*\))?|TODO|TBD", line):
            out.append(line)
    return out


def _foreign(text: str | None) -> tuple[int, int, int]:
    """Words of a text, its English function words, and the function words of the other language that has most."""
    words = _LETTERS.findall(_QUOTED.sub(" ", text or ""))
    hits = Counter(k for w in words for k in _TONGUES.get(w.lower(), ()))
    en = hits.pop("en", 0)
    return len(words), en, max(hits.values(), default=0)


def _last_word(text: str) -> tuple[str, str]:
    """The last run of letters of a text in lower case, and what stands before it."""
    end = len(text)
    while end and not text[end - 1].isalpha():
        end -= 1
    start = end
    while start and text[start - 1].isalpha():
        start -= 1
    return text[start:end].lower(), text[:start]


def _camel_free(name: str) -> str:
    return name.replace("_", "").lower()


def _word_cut(code: str, java: str) -> int:
    """1 if the last word of the code is neither one of the method's words nor one of Python's."""
    last = re.search(r"([^\W\d]\w*)\W*$", code)
    if not last or not java:
        return -1
    if last.end(1) != len(code.rstrip()):
        return 0
    known = {_camel_free(w) for w in re.findall(r"[^\W\d]\w*", java)} | {w for w in keyword.kwlist if w in ("pass", "None", "True", "False", "break", "continue", "return")}
    known |= {w.lower() for w in ("None", "True", "False")}
    return int(_camel_free(last[1]) not in known and last[1] not in ("print", "round", "str", "int", "range", "append"))


def _breaks_off(code: str, fault: SyntaxError | None) -> int:
    """1 if Python code can't be parsed and the fault lies where it ends."""
    if fault is None:
        return 0
    text = textwrap.dedent(code).strip("\n")
    head = text.lstrip().split("\n", 1)[0]
    if not _PYTHON_HEAD.match(head) or _OTHER_LINE.search(text):
        return -1
    lines = text.rstrip().count("\n") + 1
    told = fault.msg or ""
    return int((fault.lineno or 0) >= lines or any(
        x in told for x in ("never closed", "unterminated", "EOF", "expected an indented block")))


def _unended(text: str | None) -> bool:
    """Whether running text ends without a mark; list items and indented lines end without one."""
    if not text or not text.strip():
        return False
    last = text.rstrip().split("\n")[-1]
    return not re.search(r"[.!?:;)\]}`\"'»…。．！？」）।؟]$", last) and not re.match(r"\s|[-*•]|\d+[.)]", last)


def _end_lacking(plain: str, java: str) -> int:
    """1 if the words of the method's last statement are missing where the code ends."""
    lines = [x for x in _JAVA_TRIVIA.sub(" ", java).split("\n") if re.search(r"\w", x)]
    if len(lines) < 2 or "{" not in java:
        return -1
    words = {_camel_free(w) for w in re.findall(r"\w+", lines[-1])} - _JAVA_NOISE
    tail = "\n".join([x for x in plain.split("\n") if x.strip()][-2:])
    told = {_camel_free(w).lstrip("_") for w in re.findall(r"\w+", tail)}
    if not words:
        return -1
    return int(len(words & told) < 0.5 * len(words))


def votes(code: str | None, explanation: str | None, notes: str | None, java: str | None, familiar: frozenset[str] = frozenset()) -> dict[str, tuple[int, ...]]:
    """Votes of all labelling functions on one pair; ``familiar`` are the corpus's common words, where it is large enough."""
    plain, tag, fence = _plain(code or "")
    java = java or ""
    (tree, fault), lines = _parsed(plain), _lines(plain)
    idle = tree is not None and all(map(_idle, tree.body))
    whole = squeezed(java)
    body = whole[whole.find("{"):] if "{" in whole else ""
    flat, told = (squeezed(t) if t and "{" in t and "}" in t else "" for t in (plain, explanation))
    # Of code that parses and does something, only the remarks are prose.
    prose = ["\n".join(_COMMENT.findall(plain)) if tree is not None and not idle else code or "", explanation or "", notes or ""]
    said = "\n".join(s for f in prose for s in _CLAUSE.split(f) if not _DOUBT.search(s))
    words = len(_LETTERS.findall(_COMMENT.sub("", plain)))
    pythonic = _DEF.match(plain) is not None
    sentence = tree is None and words > 5 and not _BRACES_OR_DEF.search(plain)
    remark = not lines and bool(_REMARK.search(plain))
    is_copy = len(body) > 2 and (body in flat or body in told)
    statements = [x for x in (re.sub(r"\s+", "", y) for y in _JAVA_TRIVIA.sub(" ", java[java.find("{") + 1:]).split("\n")) if len(x) > 4]
    # Java statements end in marks that a text without any can't repeat.
    bare = [re.sub(r"\s+", "", _JAVA_TRIVIA.sub(" ", t)) if t and (";" in t or "{" in t) else "" for t in (plain, explanation)]
    same = max(sum(x in t for x in statements) / len(statements) for t in bare) if statements else -1.0
    repeated = is_copy or same >= 0.6
    layout = tree is None and not pythonic and len(re.findall(r"[;{}]", plain)) > 2 or len(re.findall(r"[;{}]\s*(?:\n|$)", explanation or "")) > 2
    java_words = max(len(_JAVA_ONLY.findall(plain)) if tree is None and not pythonic else 0, len(_JAVA_ONLY.findall(explanation or "")) if "{" in (explanation or "") else 0)
    texts = [f for f in (explanation, notes) if f and f.strip() and not (repeated and f is explanation)]
    counted = [_foreign(f) for f in texts]
    signs = any(not f.isascii() and not _QUOTED.sub(" ", f).isascii() and not re.search(r"[;{}]\s*\n", f) for f in texts)
    judged = bool(plain.strip()) and not (repeated or sentence or remark)
    # A head alone is a Python function cut off as well as any other.
    foreign = judged and tree is None and bool(_FOREIGN_CODE.search(plain)) and not (pythonic and "\n" not in plain.strip())
    other_code = foreign or judged and tag not in ("", "python", "py", "python3", "text", "java")
    finished = judged and not other_code
    ends = explanation.rstrip() if explanation and explanation.strip() and not repeated else ""
    last, before = _last_word(ends)
    known_last = not familiar or not last or last in familiar or last in java.lower() or len(last) > 2 and any(w.lower() == last for w in _LETTERS.findall(before))

    def unfamiliar(text: str) -> bool:
        found = _LETTERS.findall(_QUOTED.sub(" ", text).lower())
        return len(found) > 4 and sum(w in familiar or "en" in _TONGUES.get(w, ()) for w in found) < 0.45 * len(found) or len(found) <= 4 and len(text) > 40 and not text.isascii()

    return {
        "refusal": (
            int(bool(_DECLINE.search(said)) and bool(_JOB.search(said))),
            int(bool(_GROUND.search(said))),
            int(sentence or remark) if code else -1,
            int(idle or not lines),
            int(any(_SPEAKER.search(s) and _NO.search(s) for s in said.split("\n"))),
        ),
        "copy": (int(repeated) if is_copy or same >= 0 else -1, int(layout), int(java_words > 1)),
        "empty": (
            int(idle) if tree is not None else -1 if plain.strip() else 1,
            int(not lines) if not pythonic or tree is not None else 0,
            -1 if not plain.strip() else int(len(lines) <= 2 and bool(_FAILURE.match(re.sub(r"^[\s#/*]+", "", plain)))),
            int(words < 3) if tree is not None or not plain.strip() else 0,
        ),
        "language_text": (
            int(any(o > e for _, e, o in counted)) if texts else -1,
            int(any(n > 4 and e < 0.08 * n for n, e, _ in counted)) if texts else -1,
            int(signs) if texts else -1,
            int(any(map(unfamiliar, texts))) if texts and familiar else -1,
        ),
        "language_code": (
            int(foreign) if judged else -1,
            -1 if not judged or not tag else int(tag not in ("python", "py", "python3", "text", "java")),
            int(tree is None and not pythonic) if judged else -1,
            int(not _PYTHON_MARKS.search(plain)) if judged and not idle else -1,
        ),
        "truncated_text": (
            int(_unended(ends)) if ends else -1,
            int(bool(_OPEN_END.search(ends)) or not known_last) if ends and _unended(ends) else -1,
        ),
        "truncated_code": (
            _breaks_off(plain, fault) if finished else -1,
            fence if finished else -1,
            _end_lacking(plain, java) if finished and not idle else -1,
            _word_cut(plain, java) if finished and pythonic and not idle else -1,
        ),
    }


_REFUSALS = (
    "I would sooner leave this method to somebody on your side.", "Sorry, this one is beyond what I am willing to translate.",
    "I am not going to port this method; please give it to its owners.", "My answer is no: this routine should not be rewritten by me.")


def _other_tongue(text: str, r: random.Random) -> str:
    """The same text in a language that nobody speaks: letters exchanged by a rule, marks and lengths kept."""
    vowels, others = "aeiou", "bcdfghjklmnpqrstvwxyz"
    k, j = r.randrange(1, 5), r.randrange(1, 20)
    table = {ord(c): vowels[(i + k) % 5] for i, c in enumerate(vowels)} | {ord(c): others[(i + j) % 21] for i, c in enumerate(others)}
    return text.lower().translate(table).capitalize()


def damaged(code: str, explanation: str, notes: str | None, java: str, r: random.Random) -> list[tuple[str, tuple]]:
    """(sign, fields) of a sound pair damaged in every way: blanked, cut, copied, turned into another language, refused."""
    words = explanation.split()
    lines = code.rstrip().split("\n")
    cut = code[:max(1, int(len(code.rstrip()) * r.uniform(0.4, 0.9)))]
    braces = re.sub(r"(?m)^(\s*)(?:async )?def (\w+)\((?:self,? ?)?([^)]*)\)[^:]*:$", r"\1func \2(\3) {", code)
    braces = re.sub(r"(?m)^(\s*)(if|while|for)\b(.*):$", r"\1\2 (\3) {", braces) + "\n}"
    refusal = r.choice(_REFUSALS)
    out = [
        ("empty", (r.choice(["", "   ", "pass", "# ...", "return", "# ERROR: the request ran out of time before an answer came", "# still to be written by the desk that owns it", lines[0] + "\n    pass" if lines[0].rstrip().endswith(":") else "None"]), explanation, notes)),
        ("truncated_code", (cut, explanation, notes)),
        ("copy", (java, explanation, notes) if r.random() < 0.5 else (code, java, notes)),
        ("refusal", (r.choice([refusal, f"# {refusal}", ""]), refusal, notes)),
        ("language_text", (code, _other_tongue(explanation, r), notes)),
        ("language_code", (braces, explanation, notes)),
    ]
    if len(words) > 4:
        out.append(("truncated_text", (code, " ".join(words[:r.randrange(2, len(words) - 1)]).rstrip(".,;:!?"), notes)))
    return out


def common_words(conversions: DataFrame) -> frozenset[str]:
    """Words that stand in a share of all conversions' explanations and notes, a bounded number; empty for small corpora."""
    text = F.lower(F.concat_ws(" ", "explanation", "confidence_notes"))
    rows = conversions.where("conversion_id is not null").select(F.array_distinct(F.split(text, r"[^\p{L}]+")).alias("w"))
    total = rows.count()
    if total < COMMON_LEAST:
        return frozenset()
    found = rows.select(F.explode("w").alias("w")).where("w <> ''").groupBy("w").count().where(F.col("count") >= COMMON_SHARE * total)
    return frozenset(r.w for r in found.orderBy(F.desc("count"), "w").limit(COMMON_WORDS).collect())


def vote_table(conversions: DataFrame, methods: DataFrame) -> DataFrame:
    """(conversion_id, truth, <sign> array<int>...): the votes on each distinct conversion, joined to its method.

    Rows with a ``truth`` are sound pairs of the labelled sample that were damaged so, or "sound" as they are.  A conversion
    whose method is unknown or has no source is judged without it.
    """
    asked = methods.select("method_id", "source_code").where("method_id is not null and source_code is not null")
    asked = asked.groupBy("method_id").agg(F.min("source_code").alias("_java"))
    told = conversions.select("conversion_id", "method_id", "python_code", "explanation", "confidence_notes").where(
        "conversion_id is not null")
    familiar = common_words(told)
    shared = told.sparkSession.sparkContext.broadcast(familiar)
    every = max(1, told.count() // LABELLED)
    told = told.dropDuplicates(["conversion_id", "python_code", "explanation", "confidence_notes"])
    joined = told.join(asked, "method_id", "left").select(
        "conversion_id", "python_code", "explanation", "confidence_notes", "_java", (F.pmod(F.xxhash64(F.lit(11), "conversion_id"), F.lit(every)) == 0).alias("_labelled"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            out = []
            for i, code, explanation, notes, java, labelled in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                v = votes(code, explanation, notes, java, known)
                out.append((i, None, *(list(v[k]) for k in FUNCTIONS)))
                if labelled and code and java and explanation and not any(1 in x for x in v.values()):
                    out.append((i, "sound", *(list(v[k]) for k in FUNCTIONS)))
                    for truth, fields in damaged(code, explanation, notes, java, random.Random(int(i))):
                        w = votes(*fields, java, known)
                        out.append((i, truth, *(list(w[k]) for k in FUNCTIONS)))
            yield pd.DataFrame(out, columns=["conversion_id", "truth", *FUNCTIONS])

    return joined.mapInPandas(run, "conversion_id bigint, truth string, " + ", ".join(f"{k} array<int>" for k in FUNCTIONS))


class LabelModel:
    """Two-class model of votes: a prior and, per function, the chance of a vote of 1 and 0 given the class.

    A function that abstains says nothing.
    """

    def __init__(self, functions: int, prior: float = 0.03, strength: float = 0.02) -> None:
        self.prior = prior
        # Chances of a vote of 1 and 0: a defect is mostly voted for, a sound pair mostly not.
        self.start = ([[0.8, 0.2]] * functions, [[0.02, 0.98]] * functions)
        self.given = tuple([list(t) for t in part] for part in self.start)
        self.strength = strength

    def weight(self, f: int, vote: int) -> float:
        if vote < 0:
            return 0.0
        k = 1 - vote
        return math.log(self.given[0][f][k] / self.given[1][f][k])

    def posterior(self, pattern: tuple[int, ...]) -> float:
        s = math.log(self.prior / (1 - self.prior)) + sum(self.weight(f, v) for f, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, s))))

    def fit(self, counts: dict[tuple[int, ...], int], rounds: int = 50) -> LabelModel:
        """EM over pattern counts.

        The tables of sound pairs keep the weight of ``strength`` of all rows on their start, those of the rare class half
        of that class's own weight, so that EM can't turn it into something else.
        """
        total = sum(counts.values())
        if not total:
            return self
        for _ in range(rounds):
            post = {p: self.posterior(p) for p in counts}
            ones = sum(n * post[p] for p, n in counts.items())
            self.prior = min(0.5, max(1e-4, (ones + 0.001 * total) / (1.02 * total)))
            for c, mass in ((0, lambda p: post[p]), (1, lambda p: 1 - post[p])):
                for f, table in enumerate(self.given[c]):
                    size = sum(n * mass(p) for p, n in counts.items() if p[f] >= 0)
                    pseudo = max(1.0, self.strength * total if c == 1 else 0.5 * size)
                    for k, v in enumerate((1, 0)):
                        seen = sum(n * mass(p) for p, n in counts.items() if p[f] == v)
                        table[k] = max(1e-4, (seen + pseudo * self.start[c][f][k]) / (size + pseudo))
        return self

    def validated(self, sign: str, labelled: dict[str, dict[tuple[int, ...], int]], precision: float = 0.9) -> tuple[float, float, float]:
        """(cutoff, precision, recall) on pairs with known labels: the least posterior with the wanted precision.

        Each kind of damage weighs as much as this model's prior, sound pairs the rest.  A pair that is refused may be called
        empty too.  The cutoff lies half way to the next labelled pair below, but not under LEAST_POSTERIOR.  Without labelled
        pairs it is 0.5.
        """
        spared = {"empty": {"refusal"}}.get(sign, set())
        points = []
        for truth, patterns in labelled.items():
            size = sum(patterns.values())
            weight = max(0.0, 1 - 7 * self.prior) if truth == "sound" else self.prior
            if truth not in spared and size:
                points += [(self.posterior(p), weight * n / size, truth == sign) for p, n in patterns.items()]
        own = sum(w for _, w, right in points if right)
        if not own:
            return 0.5, math.nan, math.nan
        best, hit, size = (0.5, math.nan, 0.0), 0.0, 0.0
        points.sort(key=lambda x: -x[0])
        for k, (post, w, right) in enumerate(points):
            hit, size = hit + w * right, size + w
            if post < LEAST_POSTERIOR:
                break
            below = points[k + 1][0] if k + 1 < len(points) else 0.0
            if below < post and hit >= precision * size:
                best = (max(LEAST_POSTERIOR, (post + below) / 2), hit / size, hit / own)
        return best

    def column(self, of: Column) -> Column:
        """The posterior of a votes column, computed in the JVM."""
        s = F.lit(math.log(self.prior / (1 - self.prior)))
        for f in range(len(self.given[0])):
            v = F.element_at(of, f + 1)
            s = s + F.when(v == 1, self.weight(f, 1)).when(v == 0, self.weight(f, 0)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


def fitted(table: DataFrame) -> dict[str, tuple[LabelModel, tuple[float, float, float], int]]:
    """Of each sign: the model fitted on all votes, its validated (cutoff, precision, recall), and the labelled pairs."""
    # All signs' pattern counts in one pass: a sign has at most 3 ** functions patterns.
    counted = table.select("truth", F.explode(F.create_map(*[x for k in FUNCTIONS for x in (F.lit(k), F.col(k))])).alias("sign", "votes")).groupBy(
        "truth", "sign", "votes").count().collect()
    out = {}
    for k in FUNCTIONS:
        of: dict[str | None, dict[tuple[int, ...], int]] = {}
        for r in counted:
            if r.sign == k:
                of.setdefault(r.truth, {})[tuple(r.votes)] = r["count"]
        model = LabelModel(len(FUNCTIONS[k])).fit(of.pop(None, {}))
        out[k] = (model, model.validated(k, of), sum(of.get(k, {}).values()))
    return out


def scored(conversions: DataFrame, methods: DataFrame) -> DataFrame:
    """(conversion_id, defect, posterior, cutoff): every defect of every pair whose posterior reaches its validated cutoff.

    A pair can have several rows; a defect with several signs counts with the first that reaches its cutoff.  Null conversion
    ids are left out; an empty table gives no rows.
    """
    table = written(vote_table(conversions, methods), "votes")
    out = None
    for k, (model, (cut, _, _), _) in fitted(table).items():
        part = table.where("truth is null").select("conversion_id", F.lit(SIGN_OF[k]).alias("defect"), model.column(F.col(k)).alias("posterior"), F.lit(cut).alias("cutoff"))
        part = part.where("posterior >= cutoff - 1e-9")
        out = part if out is None else out.unionByName(part)
    return out


def validation(conversions: DataFrame, methods: DataFrame) -> DataFrame:
    """(sign, prior, cutoff, labelled, precision, recall): how each sign's model does on pairs damaged on purpose."""
    table = written(vote_table(conversions, methods), "votes")
    rows = [(k, model.prior, *told[:1], n, *told[1:]) for k, (model, told, n) in fitted(table).items()]
    return table.sparkSession.createDataFrame(rows, "sign string, prior double, cutoff double, labelled bigint, precision double, recall double")


def found(scores: DataFrame) -> DataFrame:
    """(conversion_id, defect): the one defect of each pair, the first of :data:`DEFECTS` that reached its cutoff."""
    rank = F.create_map(*[x for d, i in ORDER.items() for x in (F.lit(d), F.lit(i))])
    return scores.groupBy("conversion_id").agg(F.min_by("defect", rank[F.col("defect")]).alias("defect"))

"""Column functions on source text and names. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the analysis.
TAGS = "TODO|FIXME|HACK|NOTE|XXX"
ENTRY_NAMES = ("init", "run", "start", "execute")
EXEMPT_NAMES = ("toString", "hashCode", "equals", "compareTo")
EXEMPT_PREFIX = "^(get|set|is)"
CODE_WORDS = (
    "public|private|protected|static|final|abstract|class|interface|enum|import|package|return|if|else|for|while|switch"
    "|try|catch|throw|new|void|@")
TOKENS_PER_WORD = 1.3
COMMENTED_CODE = (
    r"^(public|private|protected)\s", r"^(return|if|else|for|while|switch)\s", r"^\w+\s*\(.*\)\s*[;{]", r"^\w+\s+\w+\s*=",
    r"^this\.\w+", r"^\w+\.\w+\(", r"^\}",
)
MODIFIER_ORDER = (
    "public protected private abstract static final transient volatile synchronized native strictfp default").split()


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Lines of a text; LF, CRLF and CR end a line, and a last line end opens no further line. Null gives null."""
    ended = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(ended == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(ended, r"\n\z", ""), "\n"))


def is_comment_line(line: Column) -> Column:
    """Blank lines and lines that begin with //, /* or * are comment lines."""
    s = strip(line)
    return (s == "") | s.startswith("//") | s.startswith("/*") | s.startswith("*")


def is_commented_code(line: Column) -> Column:
    """A // line whose rest looks like a statement."""
    s = strip(line)
    rest = strip(F.regexp_replace(s, "^/+", ""))
    return s.startswith("//") & rest.rlike("|".join(f"(?:{p})" for p in COMMENTED_CODE))


def is_code_line(line: Column) -> Column:
    return strip(line).rlike(f"^({CODE_WORDS})")


def has_tag(text: Column) -> Column:
    return F.upper(text).rlike(TAGS)


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded down; null counts as empty."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.floor(words * F.lit(TOKENS_PER_WORD)).cast("int")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def percent(x: Column, digits: int = 0) -> Column:
    """``x`` as a percentage, rounded half to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(x * 100, digits))


def safe_ratio(part: Column, whole: Column) -> Column:
    """1 - part / whole, or 0 where there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - part / whole)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


def is_entry_point(name: Column, modifiers: Column) -> Column:
    return ((name == "main") & F.coalesce(F.array_contains(modifiers, "static"), F.lit(False))) | name.isin(*ENTRY_NAMES)


def is_exempt(name: Column, modifiers: Column) -> Column:
    """Methods that are never reported as dead: entry points, constructors, accessors and common overrides."""
    return is_entry_point(name, modifiers) | (name == "__init__") | name.rlike(EXEMPT_PREFIX) | name.isin(*EXEMPT_NAMES)


def ordered_modifiers(modifiers: Column) -> Column:
    """Modifiers in the order that the language recommends; others follow by name."""
    rank = lambda m: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MODIFIER_ORDER)), m), F.lit(0)), F.lit(99))
    return F.transform(F.array_sort(F.transform(modifiers, lambda m: F.struct(rank(m).alias("r"), m.alias("m")))), lambda s: s.m)


def method_signature(modifiers: Column, return_type: Column, name: Column, parameters: Column) -> Column:
    mods = F.array_join(ordered_modifiers(F.coalesce(modifiers, F.array().cast("array<string>"))), " ")
    params = F.array_join(F.coalesce(parameters, F.array().cast("array<string>")), ", ")
    return strip(F.concat(mods, F.lit(" "), F.coalesce(return_type, F.lit("void")), F.lit(" "), name, F.lit("("), params,
                          F.lit(") { /* ... */ }")))


def class_signature(name: Column, extends: Column, implements: Column, fields: Column, signatures: Column) -> Column:
    head = F.concat(F.lit("class "), name, F.when(extends.isNotNull(), F.concat(F.lit(" extends "), extends)).otherwise(""),
                    F.when(F.size(implements) > 0, F.concat(F.lit(" implements "), F.array_join(implements, ", "))).otherwise(""),
                    F.lit(" {"))
    return F.array_join(F.concat(F.array(head), F.transform(fields, lambda f: F.concat(F.lit("    "), f, F.lit(";"))),
                                 F.transform(signatures, lambda s: F.concat(F.lit("    "), s)), F.array(F.lit("}"))), "\n")


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two marks, stripped: blank without the first mark, the rest of the text without the second."""
    at = F.instr(text, start)
    after = F.substring(text, at + len(start), F.length(text))
    stop = F.instr(after, end)
    return F.when(at == 0, "").otherwise(strip(F.when(stop > 0, F.substring(after, F.lit(1), stop - 1)).otherwise(after)))


def after(text: Column, mark: str) -> Column:
    """What follows a mark up to the next ===, stripped; blank without the mark."""
    return between(text, mark, "===")


def repo_name(url: Column) -> Column:
    """Last path segment of a repository address without .git; null if it is blank or holds characters of no file name."""
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(url), "/+$", ""), r"\.git$", ""), "/+$", "")
    name = F.element_at(F.split(cleaned, "/"), -1)
    return F.when((name != "") & ~name.rlike(r'[\\/:*?"<>|]'), name)

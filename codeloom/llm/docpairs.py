"""Functions paired with their documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import islands

#: Fewest words of a real description, and fewest that say more than the names do.
LEAST_WORDS = 8
LEAST_NEW_WORDS = 3

_DRESS = re.compile(r"^[ \t]*(?:/\*+|\*+/|//+|\*+(?!/)|#+)?[ \t]*|[ \t]*\*+/[ \t\r]*$")
_TAG = re.compile(r"[@\\:](?:\w+)\b|Args:|Returns:|Raises:|Parameters\s*$")
_RULE = re.compile(r"^[\W_]*$")
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|tbc|n/?a)\b")
_CODE = re.compile(r"[;{}]\s*$|^\s*[\w.]+\s*\([^)]*\)\s*$|^\s*(?:[\w.\[\]]+\s*[-+*/|&]?=[^=].*\d|import\s|package\s|@\w+)")
_NOTICE = re.compile(
    r"(?i)auto-?\s?generated|generated (?:by|from|with|method|code)|do not (?:edit|modify)|non-javadoc"
    r"|(?:add|insert|missing|write)\b.{0,20}\b(?:description|documentation|comment)\b"
    r"|description (?:goes )?here|to be (?:documented|described|written)|no description|\bsee (?:above|below|super)")
#: Scripts that put no blanks between words count by characters.
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
# Fixed value: words that tie a name into a sentence without saying anything about it.
_FILLERS = frozenset(
    "a an the this that is are was be of for to in on and or with by it its as at from method function class object value"
    " values result returns return gets get sets set does do constructor helper utility default implementation der die das"
    " le la les de du des el los las".split())


def prose(comment: str) -> str:
    """The sentences of a comment without its dress, tags, rules, to-dos, tool notices and commented-out code."""
    kept = []
    for line in comment.replace("\r", "").split("\n"):
        line = _DRESS.sub("", _DRESS.sub("", line, count=1))
        if _TAG.match(line):
            break  # all that follows the first tag belongs to tags
        if _RULE.match(line) and line.strip():
            continue
        kept.append("" if not line.strip() or _TODO.match(line) or _CODE.search(line) else line)
    text = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", re.sub(r"</?\w+[^>]*>", " ", "\n".join(kept)))
    return " ".join(s for s in _SENTENCE.split(text) if s and not _NOTICE.search(s) and not _TODO.match(s))


def is_description(comment: str | None, qualified_name: str | None) -> bool:
    """Whether a comment is prose of eight words at least that says more than the names of class and method do."""
    if not comment:
        return False
    words = [w.lower() for w in _WORD.findall(prose(comment))]
    if len(words) < LEAST_WORDS:
        return False
    names = set(_FILLERS)
    for part in re.split(r"\W+", qualified_name or ""):
        names.add(part.lower())
        names.update(p.lower() for p in _CAMEL.findall(part))
    # "Converts" after convertVoucher is the name again.
    new = {w for w in words if w not in names and not (w.endswith("s") and w[:-1] in names)}
    return len(new) >= LEAST_NEW_WORDS


def source_descriptions(methods: DataFrame) -> DataFrame:
    """(method_id, qualified_name, code, description) of methods whose own comment is a real description."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            comments = [islands.header_comment(s) for s in pdf["code"]]
            real = [is_description(c, q) for c, q in zip(comments, pdf["qualified_name"])]
            out = pdf.loc[np.array(real, bool)].copy()
            out["description"] = [prose(c) for c, ok in zip(comments, real) if ok]
            if len(out):
                yield out

    rows = methods.select("method_id", "qualified_name", F.col("source_code").alias("code")).where(
        "method_id is not null and code is not null")
    return rows.mapInPandas(run, "method_id bigint, qualified_name string, code string, description string")


def conversion_descriptions(conversions: DataFrame) -> DataFrame:
    """(method_id, description) of conversions whose documentation is a real description."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            real = [is_description(t, q) for t, q in zip(pdf["documentation"], pdf["qualified_name"])]
            out = pdf.loc[np.array(real, bool)]
            if len(out):
                yield pd.DataFrame({"method_id": out["method_id"], "description": [prose(t) for t in out["documentation"]]})

    rows = conversions.select("method_id", "qualified_name", "documentation").where(
        "method_id is not null and documentation is not null")
    return rows.mapInPandas(run, "method_id bigint, description string")


def described(methods: DataFrame, conversions: DataFrame) -> DataFrame:
    """(method_id, origin): methods with code that have a real description, by where it comes from.

    Repeated rows give one row; null ids, null code and null or blank documentation none.  Columns beside those named
    in the table descriptions are ignored.
    """
    own = source_descriptions(methods).select("method_id", F.lit("source").alias("origin"))
    known = methods.where("source_code is not null").select("method_id")
    told = conversion_descriptions(conversions).select("method_id", F.lit("documentation").alias("origin")).join(
        known, "method_id", "left_semi")
    return own.unionByName(told).distinct()


def pairs(methods: DataFrame, conversions: DataFrame) -> DataFrame:
    """(method_id, qualified_name, code, description, origin): code with each of its descriptions, once each."""
    own = source_descriptions(methods).withColumn("origin", F.lit("source"))
    code = methods.where("source_code is not null and method_id is not null").groupBy("method_id").agg(
        F.min(F.struct("qualified_name", F.col("source_code").alias("code"))).alias("m")).select("method_id", "m.*")
    told = conversion_descriptions(conversions).withColumn("origin", F.lit("documentation")).join(code, "method_id")
    return own.unionByName(told).dropDuplicates(["method_id", "origin", "description"])


def file_pairs(files: DataFrame) -> DataFrame:
    """(file_id, qualified_name, start_line, code, description) of all documented functions in source files.

    Null sources give none; a file delivered twice gives its functions once.  A function whose body is not balanced
    is water.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, f.qualified_name, f.start_line, f.code, prose(f.comment))
                for i, path, source in zip(pdf["file_id"], pdf["file_path"], pdf["raw_source"])
                for f in islands.functions(path, source)
                if is_description(f.comment, f.qualified_name)
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["file_id", "qualified_name", "start_line", "code", "description"])

    rows = files.select("file_id", "file_path", "raw_source").where(
        F.col("raw_source").isNotNull() & F.lower("file_path").rlike(r"\.(java|js|py)$"))
    return rows.mapInPandas(
        run, "file_id bigint, qualified_name string, start_line int, code string, description string"
    ).dropDuplicates(["file_id", "qualified_name", "start_line"])

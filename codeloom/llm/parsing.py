"""Source files that do not parse: lexer-state maps over chunks, then local grammars over balanced statements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import grammars, lexing

#: Lines of one chunk. A file's chunks are lexed independently, for every state they could be entered in.
CHUNK_LINES = 200


def language(file_path: Column) -> Column:
    """java, py, js or json by the suffix of a path; null for others."""
    suffix = F.lower(F.regexp_extract(file_path, r"\.([A-Za-z]+)$", 1))
    return F.when(suffix.isin(*grammars.PARSES), suffix)


def judged_files(files: DataFrame) -> DataFrame:
    """(file_id, project, language, raw_source) of files that have a source in a judged language, once each."""
    return files.select(
        "file_id", "project", language(F.col("file_path")).alias("language"), "raw_source"
    ).where("file_id is not null and language is not null and raw_source is not null")


def state_maps(judged: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(file_id, language, version, no, entries): the lexer-state map of every chunk.

    An entry tells, for a state in which the chunk may be entered, the state it ends in, the brackets it leaves
    unmatched, and the classes of its tokens.  A line that goes on behind a backslash stays with the next one.
    """
    lines = F.split("raw_source", r"(?<!\\)(?<!\\\r)\n")
    chunks = judged.select(
        "file_id", "language", F.xxhash64("raw_source").alias("version"),
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / chunk_lines).cast("int")),
            lambda i: F.array_join(F.slice(lines, i * chunk_lines + 1, chunk_lines), "\n"))).alias("no", "chunk"))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = [lexing.state_map(kind, chunk, no == 0) for kind, no, chunk in zip(pdf["language"], pdf["no"], pdf["chunk"])]
            yield pd.DataFrame({
                "file_id": pdf["file_id"], "language": pdf["language"], "version": pdf["version"], "no": pdf["no"],
                "entries": [[{"entry": k, **s._asdict()} for k, s in m.items()] for m in maps]})

    return chunks.mapInPandas(
        mapped, "file_id bigint, language string, version bigint, no int,"
                " entries array<struct<entry:string,state:string,closed:string,opened:string,stream:string>>")


def invalid_files(files: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(file_id): files that aren't syntactically valid in the language of their suffix.

    Each chunk becomes a state map in one pass over its text; only these are shuffled.  A file's maps are joined in chunk
    order, which is associative; what is not closed then, or closed by another bracket, is invalid, and the statements
    of the joined stream are parsed by local grammars.  No text is read twice.

    ``parse_errors`` is not consulted.  Null sources, null ids and other suffixes are not judged; an empty Java, Python
    or JavaScript file is valid and an empty JSON file is not.  An id delivered more than once comes out once.
    """
    listed = state_maps(judged_files(files), chunk_lines).groupBy("file_id", "language", "version").agg(
        F.array_sort(F.collect_set(F.struct("no", "entries"))).alias("maps"))  # repeated rows are equal

    @F.pandas_udf("boolean")
    def parses(language: pd.Series, maps: pd.Series) -> pd.Series:
        out = []
        for kind, chunks in zip(language, maps):
            whole = lexing.Summary(lexing.CODE, "", "", "")
            for c in chunks:
                whole = lexing.joined(whole, {e["entry"]: lexing.Summary(e["state"], e["closed"], e["opened"], e["stream"]) for e in c["entries"]})
            out.append(whole[:3] == (lexing.CODE, "", "") and grammars.PARSES[kind](whole.stream))
        return pd.Series(out, dtype=bool)

    return listed.where(~parses("language", "maps")).select("file_id").distinct()


def rates(files: DataFrame, invalid: DataFrame) -> DataFrame:
    """(project, language, files, invalid, rate) over the distinct judged files of each project."""
    ids = judged_files(files).select("file_id", "project", "language").distinct()
    marked = ids.join(invalid.select("file_id", F.lit(1).alias("_bad")), "file_id", "left")
    return marked.groupBy("project", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count("_bad").alias("invalid"),
        (F.count("_bad") / F.count(F.lit(1))).alias("rate"))

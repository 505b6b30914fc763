"""Files that nobody wrote by hand: generated, minified, vendored, or data saved as code (Re-Pair grammars).

Re-Pair replaces the most frequent digram by a rule, again and again.  Here every round replaces all digrams that are
more frequent than their neighbours in the same file, so a few rounds make the grammars of many files at once.  Ties go by a
hash of the digram's own symbols, and a rule is known by the hash of what it replaces: a file's grammar depends on that
file only, and equal stretches get equal rules in whatever repository they stand.

- Over token classes, the size of the grammar over the number of tokens is a file's rule reuse: generated files reuse
  theirs most.
- Over tokens, literals that no rule takes up are not compressible; long ones are, if the grammar of their characters is
  smaller than that of the same characters shuffled.  Incompressible literals in bulk are data.
- Rules over tokens go on to pair what stands only once in its file, as it may stand in other repositories: rules
  shared across projects show vendored copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import written

#: Tokens of one numpy pass over many files; a longer file is a pass of its own.
PASS = 30_000
#: A rule that is compared across projects stops growing at so many tokens; those of at least PHRASE_LEAST count.
PHRASE_MOST = 40
PHRASE_LEAST = 12
#: Buckets in which digrams are counted roughly before they are counted exactly.
BUCKET_BITS = 18

#: Thresholds of the kinds (see :func:`kind`).
MINIFIED_BLANKS = 0.08
DATA_SHARE, DATA_CHARS, DATA_TOKENS, DATA_FRAME = 0.5, 600, 0.3, 40
LONG_LITERAL, SHUFFLED_SHARE = 60, 0.97
GENERATED_REUSE, GENERATED_TOLD, GENERATED_TOKENS = 0.38, 0.48, 80
VENDORED_SHARE = 0.6

_TOKEN = {
    "c": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|\d[\w.]*|[^\W\d][\w$]*|[^\w\s]", re.S),
    "py": re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|\d[\w.]*|[^\W\d]\w*|[^\w\s]", re.S),
}
# Words that keep their own class.
_WORDS = frozenset(
    "class interface enum public private protected static final void int long double boolean return if else for while switch"
    " case new import package this self def function const let var try catch except raise throw extends implements".split())
_TOLD = re.compile(
    r"(?i)@generated|\bauto-?\s?generated|\bgenerated (?:from|by|automatically|code|file|with)|produced automatically|was produced by"
    r"|changes will be lost|local edits get lost|\bregenerate|built by \w+|is built by|edit the schema"
    r"|do not (?:edit|modify)(?: (?:this|the) (?:file|class|code|module)\b| (?:it )?(?:by hand|manually)\b|\W*$|\W*[.!;:,*\n])")
_LIBRARY_PATH = r"(?:^|/)(?:third[_-]?party|vendor(?:ed)?|node_modules|libs?/external|external|bower_components)/(?:[^/]+/)*[\w.]+[-@]\d+\.\d+"

#: What may stand before the first declaration: comments and annotations, which are kept, and imports.
_HEAD = {
    "c": re.compile(
        r"\s+|(//[^\n]*|/\*.*?(?:\*/|\Z)|@(?!interface\b)[\w.]+(?:\([^()]*\))?)|[\"']use strict[\"'];?|(?:package|import)\b[^;\n{]*(?:\{[^}]*\})?[^;\n]*;?"
        r"|(?:const|let|var)\s+(?:\w+|\{[^}]*\})\s*=\s*require\([^()]*\)[^;\n]*;?|#![^\n]*", re.S),
    "py": re.compile(r"\s+|(#[^\n]*|[rRuU]?\"\"\".*?(?:\"\"\"|\Z)|[rRuU]?'{3}.*?(?:'{3}|\Z))|(?:from|import)\b[^\n(]*(?:\([^)]*\))?[^\n]*", re.S),
}
#: A version or date of the licence itself says nothing about a library.
_LICENCE_VERSION = re.compile(
    r"(?i)licen[cs]es?\b[^\n\d]{0,40}(?:\n[^\n\d]{0,12})?(?:version|v)?[ .-]*\d+(?:\.\d+)+|\b(?:[AL]?GPL|MPL|EPL|Apache|BSD|BSL|CC)\b[^\n\d]{0,12}\d+\.\d+")
_LICENCE = re.compile(r"(?i)@licen[cs]e|free licen[cs]e|licen[cs]ed under|copyright|\(c\)|redistribution|released under")


def head_comments(text: str, suffix: str) -> list[str]:
    """The comments and annotations before the first declaration, however long; successive line comments are one."""
    part, at, out, line_end = _HEAD["py" if suffix == "py" else "c"], 0, [], -1
    while (m := part.match(text, at)) and m.end() > at:
        if m[1]:
            if line_end >= 0 and m[1].startswith(("//", "#")) and text.count("\n", line_end, at) <= 1 and not text[line_end:at].strip():
                out[-1] += "\n" + m[1]
            else:
                out.append(m[1])
            line_end = m.end() if m[1].startswith(("//", "#")) else -1
        at = m.end()
    return out


def is_banner(comment: str) -> bool:
    """Whether a file's first comment is a library's own: its version and its licence, on whatever lines."""
    return bool(_LICENCE.search(comment) and re.search(r"\d+\.\d+", _LICENCE_VERSION.sub(" ", comment)))


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _chosen(priority: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Digrams to replace: those of locally greatest priority; in a run of equal ones, every other."""
    p = np.where(allowed, priority, np.uint64(0))
    if not len(p):
        return np.zeros(0, bool)
    at = np.arange(len(p))
    fresh = np.concatenate([[True], p[1:] != p[:-1]])
    start = np.maximum.accumulate(np.where(fresh, at, 0))
    last = np.concatenate([fresh[1:], [True]])
    end = np.minimum.accumulate(np.where(last, at, len(p))[::-1])[::-1]
    before = np.where(start > 0, p[np.maximum(start - 1, 0)], 0)
    after = np.where(end + 1 < len(p), p[np.minimum(end + 1, len(p) - 1)], 0)
    return allowed & (p > before) & (p > after) & ((at - start) % 2 == 0)


def _replaced(chosen: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns without the second symbol of each chosen digram."""
    keep = np.ones(len(chosen) + 1, bool)
    keep[1:] = ~chosen
    return [c[keep] for c in columns]


def _counted(key: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, group, count) of the allowed positions whose key stands at ``least`` times or more."""
    at = np.flatnonzero(allowed)
    rough = (key[at] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    at = at[np.bincount(rough, minlength=1 << BUCKET_BITS)[rough] >= least]
    _, group, count = np.unique(key[at], return_inverse=True, return_counts=True)
    kept = count[group] >= least
    return at[kept], group[kept], count[group[kept]]


def grammar(symbols: np.ndarray, owner: np.ndarray, files: int, least: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, size, owner, rules): what is left of each file when no digram stands ``least`` times in it any more.

    ``size`` is the number of tokens a symbol stands for, ``rules`` the number of rules of each file; no rule grows beyond
    ``most`` tokens.  Each round makes the sequence shorter, so it ends.
    """
    s, size, rules = symbols, np.ones(len(symbols), np.int64), np.zeros(files, np.int64)
    while len(s) > 1:
        digram = _mix(s[:-1], s[1:] + np.uint64(1))
        allowed = owner[:-1] == owner[1:]
        if most:
            allowed &= size[:-1] + size[1:] <= most
        at, group, count = _counted(_mix(digram, owner[:-1].astype(np.uint64)), allowed, least)
        if not len(at):
            break
        priority = np.zeros(len(digram), np.uint64)
        priority[at] = (count.astype(np.uint64) << np.uint64(40)) | (digram[at] >> np.uint64(24))
        allowed = np.zeros(len(digram), bool)
        allowed[at] = True
        chosen = _chosen(priority, allowed)
        # A digram that lost most of its places to a better one makes no rule.
        picked = chosen[at]
        picked &= np.bincount(group[picked], minlength=int(group.max()) + 1)[group] >= 2
        chosen[at] = picked
        if not picked.any():
            break
        first = np.unique(group[picked], return_index=True)[1]
        rules += np.bincount(owner[at[picked][first]], minlength=files)
        s = np.concatenate([np.where(chosen, digram, s[:-1]), s[-1:]])
        size = np.concatenate([np.where(chosen, size[:-1] + size[1:], size[:-1]), size[-1:]])
        s, size, owner = _replaced(chosen, s, size, owner)
    return s, size, owner, rules


def paired(s: np.ndarray, size: np.ndarray, owner: np.ndarray, most: int = PHRASE_MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, size, owner) when digrams that stand once in their file are rules too, up to ``most`` tokens."""
    while len(s) > 1:
        digram = _mix(s[:-1], s[1:] + np.uint64(1))
        chosen = _chosen(digram, (owner[:-1] == owner[1:]) & (size[:-1] + size[1:] <= most))
        if not chosen.any():
            break
        s = np.concatenate([np.where(chosen, digram, s[:-1]), s[-1:]])
        size = np.concatenate([np.where(chosen, size[:-1] + size[1:], size[:-1]), size[-1:]])
        s, size, owner = _replaced(chosen, s, size, owner)
    return s, size, owner


def incompressible(text: str) -> bool:
    """Whether the grammar of a text's characters is hardly smaller than that of the same characters in a random order."""
    if not text:
        return False
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    alone = np.zeros(len(chars), np.int64)

    def cost(sequence: np.ndarray) -> int:
        left, _, _, rules = grammar(sequence, alone, 1, 3)
        return len(left) + 2 * int(rules[0])

    return cost(chars) >= SHUFFLED_SHARE * cost(np.random.default_rng(0).permutation(chars))


class _Symbols(dict):
    """Symbol, class and literal length (0 for others) of each token text; remembered up to a bound."""

    def __missing__(self, token: str) -> tuple[int, int, int]:
        import xxhash

        if len(self) > 1 << 18:
            self.clear()
        c = token[0]
        literal = c in "\"'`" or c.isdigit()
        h = xxhash.xxh64_intdigest(token)
        kind = 1 if literal else 2 if (c.isalpha() or c in "_$") and token not in _WORDS else h
        self[token] = out = (h, kind, len(token) if literal else 0)
        return out


def _features(texts: list[tuple[str, str]], known: _Symbols) -> tuple[dict[str, list], list[list[dict]]]:
    """Columns of features of (suffix, source), and each file's rules for comparison, in one pass."""
    files, found = len(texts), []
    for suffix, text in texts:
        found.append([t for t in _TOKEN["py" if suffix == "py" else "c"].findall(text) if t[0] != "#" and t[:2] not in ("//", "/*")])
    each = [[known[t] for t in f] for f in found]
    owner = np.repeat(np.arange(files), [len(f) for f in found])
    symbols, classes, length = (np.array([e[k] for es in each for e in es], np.uint64) for k in (0, 1, 2))
    left, _, of, rules = grammar(classes, owner, files, 3)
    tokens = np.bincount(owner, minlength=files)
    reuse = (np.bincount(of, minlength=files) + 2 * rules) / np.maximum(tokens, 1)
    s, size, of, _ = grammar(symbols, owner, files, 2, PHRASE_MOST)
    # Literals that no rule takes up.
    bare = length[(np.cumsum(size) - size)[size == 1]].astype(np.int64)
    short = np.where(bare > LONG_LITERAL, 0, bare)
    dense = np.bincount(of[size == 1], weights=short, minlength=files).astype(np.int64)
    in_literals = np.bincount(owner, weights=length, minlength=files).astype(np.int64)
    literals = np.bincount(owner, weights=length > 0, minlength=files).astype(np.int64)
    in_tokens = [sum(map(len, f)) for f in found]
    for k in np.flatnonzero((in_literals >= DATA_SHARE * np.array(in_tokens)) & (in_literals >= DATA_CHARS)):
        long = "".join(t[1:-1] for t, e in zip(found[k], each[k]) if e[2] > LONG_LITERAL)
        dense[k] += len(long) * incompressible(long)
    s, size, of = paired(s, size, of)
    cuts = np.searchsorted(of, np.arange(files + 1))
    phrases = [[{"rule": r, "size": z} for r, z in zip(s[a:b].astype(np.int64).tolist(), size[a:b].tolist()) if z >= PHRASE_LEAST] for a, b in zip(cuts, cuts[1:])]
    heads = [head_comments(text, suffix) for suffix, text in texts]
    return {
        "tokens": tokens, "literals": literals, "token_chars": in_tokens, "dense_chars": dense, "reuse": reuse,
        "blanks": [sum(map(text.count, " \n\t\r")) / max(1, len(text)) for _, text in texts],
        "told": [any(map(_TOLD.search, h)) for h in heads], "markup": [text.lstrip()[:1] in ("<", "{") for _, text in texts],
        "banner": [bool(h) and text.lstrip().startswith(h[0][:2]) and is_banner(h[0]) for h, (_, text) in zip(heads, texts)]}, phrases


def described(files: DataFrame) -> DataFrame:
    """(file_id, project, suffix, features, phrases): what the grammars say of each code file.

    ``phrases`` lists (rule, tokens).  Null ids and sources and files without a code suffix are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Symbols()
        for pdf in batches:
            lo, sizes = 0, [len(t) // 3 for t in pdf["raw_source"]]
            while lo < len(pdf):
                hi, total = lo + 1, sizes[lo]
                while hi < len(pdf) and total + sizes[hi] <= PASS:
                    total += sizes[hi]
                    hi += 1
                part = pdf.iloc[lo:hi]
                features, phrases = _features(list(zip(part["suffix"], part["raw_source"])), known)
                yield part[["file_id", "project", "suffix", "in_library"]].assign(**features, phrases=phrases)
                lo = hi

    suffix = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    code = files.select("file_id", "project", suffix.alias("suffix"), F.coalesce(F.col("file_path").rlike(_LIBRARY_PATH), F.lit(False)).alias("in_library"),
                        "raw_source").where(F.col("file_id").isNotNull() & F.col("raw_source").isNotNull() & F.col("suffix").isin("java", "js", "py"))
    return code.mapInPandas(
        run, "file_id bigint, project string, suffix string, in_library boolean, tokens bigint, literals bigint, token_chars bigint, dense_chars bigint,"
             " reuse double, blanks double, told boolean, markup boolean, banner boolean, phrases array<struct<rule:bigint,size:bigint>>")


def kind(shared: Column, notices: bool = True) -> Column:
    """The kind of a described file, or null for hand-written source.

    minified: a script with hardly any blanks.  data: incompressible literals in bulk with little code around them.
    generated: a small grammar; markup and JSON saved under a code suffix repeat themselves too and are none.  vendored:
    mostly rules that other projects have too.  With ``notices``, a rather small grammar is enough in a file whose head says
    that it was generated, and so is a library's own banner or versioned folder.
    """
    data = ((F.col("dense_chars") >= DATA_SHARE * F.col("token_chars")) & (F.col("dense_chars") >= DATA_CHARS)
            & ((F.col("literals") >= DATA_TOKENS * F.col("tokens")) | (F.col("tokens") - F.col("literals") <= DATA_FRAME)))
    small, library = F.col("reuse") < GENERATED_REUSE, shared >= VENDORED_SHARE
    if notices:
        small = small | F.col("told") & (F.col("reuse") < GENERATED_TOLD)
        library = library | F.col("in_library") | F.col("banner")
    return (
        F.when((F.col("suffix") == "js") & (F.col("blanks") < MINIFIED_BLANKS) & (F.col("tokens") >= 50), "minified")
        .when(data, "data").when((F.col("tokens") >= GENERATED_TOKENS) & ~F.col("markup") & small, "generated").when(library, "vendored"))


def judged(files: DataFrame) -> DataFrame:
    """(file_id, project, reuse, shared, kind, by_notice) of every code file; ``shared`` is the share of its tokens in rules
    that other projects have too, ``by_notice`` tells that the grammars alone would give another kind.

    An id that was delivered more than once comes out once; differing deliveries give the first kind by name.  Rules
    are counted per file before they are shuffled, and only their least and greatest project is kept, so a rule that
    stands in a third of all files is one small record.
    """
    table = written(described(files), "grammars")
    rules = table.select("file_id", "project", F.explode("phrases").alias("p")).select("file_id", "project", "p.rule", "p.size")
    places = rules.groupBy("file_id", "project", "rule").agg(F.sum("size").alias("size"))
    common = places.groupBy("rule").agg(F.min("project").alias("_lo"), F.max("project").alias("_hi")).where("_lo <> _hi")
    copied = places.join(common.select("rule"), "rule", "left_semi").groupBy("file_id").agg(F.sum("size").alias("copied"))
    own = places.groupBy("file_id").agg(F.sum("size").alias("sized")).join(copied, "file_id", "left").select(
        "file_id", (F.coalesce("copied", F.lit(0)) / F.col("sized")).alias("shared"))
    shared = F.coalesce("shared", F.lit(0.0))
    return table.drop("phrases").join(own, "file_id", "left").select(
        "file_id", "project", "reuse", shared.alias("shared"), kind(shared).alias("kind"), (~kind(shared).eqNullSafe(kind(shared, False))).alias("by_notice")).groupBy(
        "file_id").agg(F.min("project").alias("project"), F.min("reuse").alias("reuse"), F.max("shared").alias("shared"),
                       F.min("kind").alias("kind"), F.min_by("by_notice", F.coalesce("kind", F.lit("~"))).alias("by_notice"))


def report(judgements: DataFrame) -> DataFrame:
    """(project, files, generated, minified, vendored, data, by_hand, by_notice) per project; ``by_notice`` counts files that a
    notice, a banner or a folder put there and the grammars alone would not."""
    return judgements.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("generated", "minified", "vendored", "data")],
        F.count_if(F.col("kind").isNull()).alias("by_hand"), F.count_if("by_notice").alias("by_notice"))

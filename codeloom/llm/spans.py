"""Long exact spans shared between records (super-k-mer partitioning).

A window is ``span`` consecutive code points.  Its minimiser is the ``anchor``-long piece with the smallest hash.
Consecutive windows with the same minimiser form one super-k-mer; equal windows have equal minimisers, so they meet
in the bucket of that minimiser.  Steps:

1. every text is cut into super-k-mers; only (minimiser hash, doc, start, length) is shuffled to the buckets, and
   buckets that a single document fills are dropped,
2. the remaining super-k-mers travel to their bucket as packed strings; equal strings form one class, so a passage
   that was copied many times is one class whatever the number of its copies,
3. classes of a bucket that differ as a whole are sorted by their windows; equal windows join the classes.

Links are between classes, and a class has its members; each distinct member set is expanded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.tables import written

SPAN = 200
ANCHOR = 100
#: Documents of a set are paired in blocks of about this many.
PAIR_BLOCK = 2000
#: Code points that are hashed together in one numpy pass; a longer text is a pass of its own.
PASS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse."""
    base = int(_BASE)
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(base), np.uint64(inverse)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    best, have = h, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best


def super_kmers(texts: list[str], span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text no, minimiser hash, start, length) of all super-k-mers of texts that are at least ``span`` long."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    up, down = _powers(len(codes))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
        pieces = _mixed((sums[anchor:] - sums[:-anchor]) * down[: len(codes) - anchor + 1])
    least = _sliding_min(pieces, span - anchor + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    whole = np.arange(len(least)) + span <= ends[owner]
    # A new super-k-mer starts where the minimiser or the text changes. Equal hashes in a row are one bucket anyway.
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    # Periodic text keeps one minimiser on and on; such runs are cut, as equal windows meet in the bucket anyway.
    at = np.arange(len(least))
    first |= whole & ((at - np.maximum.accumulate(np.where(first, at, 0))) % (2 * (span - anchor + 1)) == 0)
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(whole & ~np.concatenate([whole[1:] & ~first[1:], [False]]))
    who = owner[starts]
    return who, least[starts], starts - (ends - lengths)[who], stops - starts + span


def cut(docs: DataFrame, doc_id: str, text: str, span: int, anchor: int) -> DataFrame:
    """(bucket, doc, at, len): the super-k-mers of each text; ``at`` counts code points from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc"].to_numpy(), pdf["text"].tolist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PASS):
                    size += len(texts[hi])
                    hi += 1
                who, bucket, at, length = super_kmers(texts[lo:hi], span, anchor)
                yield pd.DataFrame({"bucket": bucket.astype(np.int64), "doc": ids[lo:hi][who], "at": at + 1,
                                    "len": length})
                lo = hi

    long = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).where(
        F.col("doc").isNotNull() & (F.char_length("text") >= span))
    return long.mapInPandas(run, "bucket bigint, doc bigint, at bigint, len bigint")


def packed_strings(text: str, places: str) -> Column:
    """Each text's super-k-mers with their strings; a slice costs its own length only, however long the text."""
    @F.pandas_udf("array<struct<bucket:bigint,at:bigint,len:bigint,packed:string>>")
    def sliced(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([[{"bucket": p["bucket"], "at": p["at"], "len": p["len"], "packed": t[p["at"] - 1:p["at"] - 1 + p["len"]]} for p in each]
                          for t, each in zip(text, places)])

    return sliced(text, places)


def _key(of: str) -> list:
    """128 bits that stand for a string in shuffles."""
    return [F.xxhash64(F.lit(1), F.col(of)), F.xxhash64(F.lit(2), F.col(of))]


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                 anchor: int = ANCHOR) -> DataFrame:
    """(key1, key2, doc, at, len): stretches of each document whose windows all stand in another document too.

    Rows with one key belong to one set of documents that share a stretch.  Null ids, null texts and texts under ``span`` code points have
    no window; a document id delivered more than once counts as one document; a span that is repeated within one
    document only gives no row.  Other columns of ``docs`` are ignored.
    """
    rows = docs.select(doc_id, text)
    kmers = written(cut(rows, doc_id, text, span, anchor), "kmers")
    many = kmers.groupBy("bucket").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).where("_lo <> _hi")
    kept = kmers.join(many.select("bucket"), "bucket", "left_semi")
    # The packed strings travel to their bucket.
    places = kept.groupBy("doc").agg(F.collect_list(F.struct("bucket", "at", "len")).alias("places"))
    source = rows.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    packed = source.join(places, "doc").select("doc", F.explode(packed_strings("text", "places")).alias("p")).select(
        F.col("p.bucket").alias("bucket"), "doc", F.col("p.at").alias("at"), F.col("p.len").alias("len"), F.col("p.packed").alias("packed"))
    k1, k2 = _key("packed")
    packed = written(packed.withColumns({"c1": k1, "c2": k2}), "packed")
    classes = packed.groupBy("bucket", "c1", "c2").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("packed").alias("packed"), F.first("len").alias("len"))
    members = packed.select("bucket", "c1", "c2", "doc", "at", "len")
    found = written(classes, "classes")
    same = members.join(found.where("lo <> hi").select("bucket", "c1", "c2"), ["bucket", "c1", "c2"], "left_semi")
    whole = same.select(F.col("c1").alias("key1"), F.col("c2").alias("key2"), "doc", "at", "len")
    # Different strings in one bucket: their windows are sorted and counted by class, not by document.
    crowded = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    windows = found.join(crowded, "bucket", "left_semi").select(
        "bucket", "c1", "c2", "lo", "hi", "packed",
        F.explode(F.sequence(F.lit(1), (F.col("len") - span + 1).cast("int"))).alias("off")
    ).withColumn("w", F.substring("packed", F.col("off"), F.lit(span)))
    w1, w2 = _key("w")
    windows = windows.select("bucket", "c1", "c2", "lo", "hi", "off", w1.alias("w1"), w2.alias("w2"))
    of_class = windows.groupBy("bucket", "w1", "w2", "c1", "c2").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.collect_list("off").alias("offs"))
    # A set of classes is known by the sums of its members' hashes; all windows of one set have one key.
    sets = of_class.groupBy("bucket", "w1", "w2").agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.bit_xor(F.xxhash64(F.lit(3), "bucket", "c1", "c2")).alias("key1"),
        F.bit_xor(F.xxhash64(F.lit(4), "bucket", "c1", "c2")).alias("key2"),
    ).where("n > 1 and lo <> hi").select("bucket", "w1", "w2", "key1", "key2")
    met = of_class.select("bucket", "w1", "w2", "c1", "c2", "offs").join(sets, ["bucket", "w1", "w2"])
    # Consecutive windows of a class that belong to one set are one stretch.
    offs = met.groupBy("bucket", "c1", "c2", "key1", "key2").agg(
        F.array_sort(F.flatten(F.collect_list("offs"))).alias("offs"))
    firsts = F.filter("offs", lambda o: ~F.array_contains("offs", o - 1))
    lasts = F.filter("offs", lambda o: ~F.array_contains("offs", o + 1))
    stretches = offs.select("bucket", "c1", "c2", "key1", "key2", F.explode(F.arrays_zip(
        firsts.alias("first"), lasts.alias("last"))).alias("o"))
    edges = members.join(stretches, ["bucket", "c1", "c2"]).select(
        "key1", "key2", "doc", (F.col("at") + F.col("o.first") - 1).alias("at"),
        (F.col("o.last") - F.col("o.first") + span).cast("bigint").alias("len"))
    return whole.unionByName(edges)


def _sets(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key1, key2, doc) of every stretch, and (key1, key2, n) of one stretch for each distinct set of documents."""
    held = spans.select("key1", "key2", "doc").distinct()
    sets = held.groupBy("key1", "key2").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "doc")).alias("s2"))
    one = sets.where("n > 1").groupBy("n", "s1", "s2").agg(F.min(F.struct("key1", "key2")).alias("k")).select("k.*", "n")
    return held, one


def shared_pairs(spans: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents that hold one stretch.

    Stretches with the same set of documents are expanded once: a long passage has many keys but one set.  A set of many
    documents is cut into blocks of about ``block``, and every two blocks are joined by themselves, so that a passage which a
    third of all documents hold is spread over all tasks.  The expansion itself is as large as the result that the task
    asks for; :func:`shared_classes` gives the same links without it.
    """
    held, one = _sets(spans)
    k = F.ceil(F.col("n") / block).cast("int")
    part = held.join(one.select("key1", "key2", k.alias("_k")), ["key1", "key2"]).withColumn(
        "_part", F.pmod(F.xxhash64(F.lit(9), "doc"), F.col("_k")).cast("int"))
    a = part.select("key1", "key2", F.col("doc").alias("_a"), F.col("_part").alias("_pa"),
                    F.explode(F.sequence("_part", F.col("_k") - 1)).alias("_pb"))
    b = part.select("key1", "key2", F.col("doc").alias("_b"), F.col("_part").alias("_pb"),
                    F.explode(F.sequence(F.lit(0), "_part")).alias("_pa"))
    return a.join(b, ["key1", "key2", "_pa", "_pb"]).where("_pa < _pb or _a < _b").select(
        F.least("_a", "_b").alias("doc_id_a"), F.greatest("_a", "_b").alias("doc_id_b")).distinct()


def shared_classes(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, members, links) and (class_id, doc_id): the links of :func:`shared_pairs` by class, not by pair.

    A class is a distinct set of documents that hold one stretch, named by that stretch's key; every two of its members
    are linked.
    """
    held, one = _sets(spans)
    name = F.format_string("%016x%016x", "key1", "key2").alias("class_id")
    n = F.col("n")
    classes = one.select(name, n.alias("members"), (n * (n - 1) / 2).cast("bigint").alias("links"))
    return classes, held.join(one.select("key1", "key2"), ["key1", "key2"]).select(name, F.col("doc").alias("doc_id"))


def shared_share(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document; 0 where nothing is shared or the text is empty."""
    order = W.partitionBy("doc").orderBy("at", "len").rowsBetween(W.unboundedPreceding, -1)
    stop = F.col("at") + F.col("len")
    seen = F.coalesce(F.max(stop).over(order), F.lit(0))
    covered = spans.select("doc", "at", "len").distinct().withColumn(
        "_add", F.greatest(stop - F.greatest(F.col("at"), seen), F.lit(0)))
    sums = covered.groupBy("doc").agg(F.sum("_add").alias("shared_chars"))
    all_docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.coalesce(F.char_length(text), F.lit(0)).alias("n")
                           ).groupBy("doc").agg(F.max("n").cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return all_docs.join(sums, "doc", "left").select(
        F.col("doc").alias(doc_id), "n_chars", shared.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))

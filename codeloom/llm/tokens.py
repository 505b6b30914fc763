"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, and which one measures sizes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose token count a task remembers before it starts anew.
REMEMBERED = 1 << 19

# Fixed value: how the byte-level BPE vocabulary splits text into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(vocabulary: str) -> Callable[[str], int]:
    """Exact token counts; a piece that recurs is encoded once, as pieces never share a token."""
    import base64

    import regex
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = regex.compile(PATTERN).findall

    class Known(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n = len(encoding.encode_ordinary(piece))
            return n

    known = Known().__getitem__
    return lambda text: sum(map(known, pieces(text)))


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, tokens): null and empty texts have 0 tokens. Whole texts are counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for pdf in batches:
            texts = pdf.pop("_text")
            yield pdf.assign(tokens=[count(t) if t else 0 for t in texts])

    rows = docs.select(doc_id, *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (doc_id, *keep))
    return rows.mapInPandas(run, f"{schema}, tokens bigint")

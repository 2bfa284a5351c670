"""Problem 7: token ids of a whole corpus under a public byte-level BPE vocabulary.

A text is cut before every blank that a non-blank follows. No piece of the vocabulary's pattern crosses such a cut, so
the chunks can be encoded one by one, and the ids of a chunk seen before are looked up. A new chunk goes through the
pattern; a new word goes through the merges. For a short word these run on a contiguous rank array: the boundaries of
the parts and the rank of each pair of neighbours; the least rank is found by a scan, its boundary deleted and the ranks
beside it refreshed. Long words use the same merges with a queue, as scans would be quadratic there.

Defined results: null and empty texts have no ids (an empty array). Strings that look like special tokens are ordinary
text. Texts are encoded whole. The look-up tables are bounded; beyond the bound they start anew.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import spread

#: Where the rank files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that cuts text into words before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of up to so many bytes are merged by scans of the rank array.
SHORT = 160
#: Chunks and words kept per worker, and the longest kept.
KEPT, KEPT_CHARS = 400_000, 40
_NONE = 1 << 30


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated scans of the rank array."""
    bounds = list(range(len(word) + 1))
    get = ranks.get
    pair = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == _NONE:
            break
        i = pair.index(least)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            pair[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length, in n log n steps."""
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    alive = bytearray(b"\1") * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                heapq.heappush(queue, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
            heapq.heappush(queue, (r, p, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


class _Chunks(dict):
    """Ids, as bytes of 32-bit integers, of chunks with what goes before them."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.encoder.words.__getitem__, self.encoder.cut(self.before + chunk)))
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = ids
        return ids


class _Words(dict):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        found = np.array(ids, "<i4").tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Byte-level BPE with one vocabulary."""

    # A cut goes before a blank that something other than white space follows. Characters that some engines count as
    # white space and others don't never follow a cut.
    _cut = re.compile("[ ](?=[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b-\\u200d\\u2060\\ufeff])")

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.cut: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.words = _Words(ranks)
        self.first, self.later = _Chunks(self, ""), _Chunks(self, " ")

    def encode_bytes(self, text: str) -> bytes:
        head, *rest = self._cut.split(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist() if text else []


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = hash(shared.value)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(shared.value))
    return _encoders[key]


def _ids_of(texts: pa.Array, encoder: Encoder) -> pa.Array:
    parts = [encoder.encode_bytes(t) if t else b"" for t in texts.to_pylist()]
    ends = np.cumsum([0, *(len(p) >> 2 for p in parts)])
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch of texts has too many tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends.astype("i4")), ids)


def _vocabulary(spark: SparkSession, name: str, folder: str):
    """The rank file, read once by the driver. It is a vocabulary of a fixed size (under 1 MB), so it may be broadcast."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(spark: SparkSession, text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """ARRAY<INT>: the ids of text, without special tokens; an empty array for null and empty texts."""
    shared = _vocabulary(spark, name, folder)

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for texts in batches:
            yield _ids_of(texts, encoder)

    ids.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(ids, T.ArrayType(T.IntegerType()))(F.col(f"`{text}`") if isinstance(text, str) else text)


def token_count(spark: SparkSession, text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """BIGINT: the number of ids of text; 0 for null and empty texts."""
    shared = _vocabulary(spark, name, folder)

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for texts in batches:
            yield pa.array([len(encoder.encode_bytes(t)) >> 2 if t else 0 for t in texts.to_pylist()], pa.int64())

    counts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counts, T.LongType())(F.col(f"`{text}`") if isinstance(text, str) else text)


def encode_corpus(df: DataFrame, ident: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """ident and ids of every row of df. There is no shuffle, unless the table has fewer partitions than there are cores."""
    rows = spread(df.select(F.col(f"`{ident}`"), F.col(f"`{text}`").alias("__text")))
    return rows.select(F.col(f"`{ident}`"), token_ids(df.sparkSession, "__text", name, folder).alias("ids"))

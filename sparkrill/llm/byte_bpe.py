"""Encoding texts with a public byte-level BPE vocabulary by a rank queue over hierarchical bitmaps.

A pre-token is a linked list of symbols over its bytes. The queue has a bucket for each merge rank that
holds list positions; a two-level bitmap over the ranks finds the lowest filled bucket by find-first-set.
A merge changes two neighbouring pairs, whose old entries stay in their buckets and are skipped as stale.
So a merge costs constant queue work however long the pre-token is. Finished pre-tokens are kept in a
cache of bounded size in each worker.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrill.llm.tokenizer_files import BYTE_BPE, TOKENIZERS, ranks_of, ship

# Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern for the faster module, where letters, digits and blanks mean the same in both.
FAST_PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
# Numbers that aren't decimal digits, and the control characters that only one module takes for blanks.
UNLIKE = frozenset([c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No")] + ["\x1c", "\x1d", "\x1e", "\x1f"])
UNLIKE_ASCII = re.compile("[\x1c-\x1f]")
LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
CACHED_PIECES = 300_000
LONGEST_CACHED = 200


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PRE_TOKEN) -> None:
        import regex

        self.ranks = ranks
        self.any_split = regex.compile(pattern).findall
        self.fast_split = re.compile(FAST_PRE_TOKEN).findall
        self.is_default = pattern == PRE_TOKEN
        self.cache: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of text."""
        if self.is_default and (UNLIKE_ASCII.search(text) is None if text.isascii() else UNLIKE.isdisjoint(text)):
            return self.fast_split(text)
        return self.any_split(text)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        following = list(range(1, n + 2))  # where the next symbol begins
        before = list(range(-1, n))
        pair = [get(data[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that begins here, -1 if none
        pair.append(-1)
        # The queue: positions by rank, a bitmap over the ranks of each leaf, a bitmap over the leaves.
        top, leaves, buckets = 0, {}, {}
        changed = [i for i in range(n - 1) if pair[i] >= 0]
        while True:
            for i in changed:
                rank = pair[i]
                if (bucket := buckets.get(rank)) is not None:
                    heappush(bucket, i)
                    continue
                buckets[rank] = [i]
                leaf = rank >> LEAF_BITS
                leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & LEAF_MASK)
                top |= 1 << leaf
            if not top:
                break
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            rank = (leaf << LEAF_BITS) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                leaves[leaf] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            changed = []
            if pair[i] != rank:
                continue  # stale
            right = following[i]
            following[i] = after = following[right]
            pair[right] = -1
            if after < n:
                before[after] = i
                pair[i] = rank = get(data[i : following[after]], -1)
                if rank >= 0:
                    changed.append(i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = rank = get(data[left:after], -1)
                if rank >= 0:
                    changed.append(left)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[data[i : following[i]]])
            i = following[i]
        return ids

    def _missing(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= LONGEST_CACHED:
            if len(self.cache) >= CACHED_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, missing = self.cache.get, self._missing
        return list(chain.from_iterable([get(p) or missing(p) for p in self.split(text)]))

    def count(self, text: str) -> int:
        get, missing = self.cache.get, self._missing
        return sum([len(get(p) or missing(p)) for p in self.split(text)])


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, name: str = BYTE_BPE) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(ranks_of(folder, name))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE) -> DataFrame:
    """(id, ids): the token ids of each whole text, without special tokens.

    An empty text and a null text both give the empty list; repeated rows give repeated rows; an empty table
    an empty one. Strings of special tokens within a text are ordinary text. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    ids.extend(encode(text))
                ends.append(len(ids))
            values = pa.array(memoryview(ids), pa.int32()) if len(ids) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), values)], ["id", "ids"])

    ship(docs.sparkSession, folder, name)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, ids array<int>").select(F.col("id").alias(id_col), "ids")

"""Token counts by byte-pair merges read from a file of ranks, as a column function for budgets and the engine.

The file has a line for each token: its bytes in base64 and its rank. A text is cut into words by a pattern; of a word's neighbouring parts
the pair whose union has the least rank is merged until no union is a token."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how texts are cut into words for the common byte-level vocabularies of 50,000 tokens.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Words whose counts a task remembers.
MEMO = 200_000


def merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """The number of parts that are left of a word. Pairs wait in a heap, so long words cost little more than their length."""
    if word in ranks:
        return 1
    n = len(word)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    gone = bytearray(n)

    def pair(i: int):
        j = after[i]
        return ranks.get(word[i : ends[j]]) if j < n else None

    heap = [(r, i, ends[i], i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if gone[i] or ends[i] != middle or after[i] >= n or ends[after[i]] != end:
            continue  # one of the parts has changed since
        j = after[i]
        gone[j], ends[i], after[i] = 1, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        left -= 1
        for k in (i, before[i]):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, ends[k], ends[after[k]]))
    return left


class Counter:
    """Counts of texts by one vocabulary."""

    def __init__(self, path: str, pattern: str = WORDS):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.words, self.memo = regex.compile(pattern), {}

    def word(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = self.memo[word] = merged(word.encode(), self.ranks)
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.word, self.words.findall(text))) if text else 0


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    """A Python worker reads a vocabulary once."""
    return Counter(path, pattern)


def token_counter(path: str, pattern: str = WORDS) -> Callable[[Column], Column]:
    """A function from a column of texts to one of their token counts (0 without a text). The file must be where the tasks run."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(path, pattern).count
        return pa.array([count(t) for t in texts.to_pylist()], pa.int64())

    return counted

"""SentencePiece encoding and decoding by suffix-array matching; the model is read, never trained.

Texts are cut into segments that no piece can cross: a piece has its blank marks in front only, so a segment is a run of
marks and the word after it (characters that stand in no longer piece, such as line ends, stand alone). The distinct new
segments of a batch are laid end to end; a suffix array of that batch text, ordered by as many characters as the longest
piece has, is built, and every piece of the vocabulary is looked up in it by binary search: its range of suffixes is
where it occurs. The edges (position, length, rank), sorted by position, are then relaxed as the model's byte-pair rule
wants it: in each segment the adjacent pair of symbols with the best edge over both, the leftmost of equals, becomes one
symbol, until no pair has an edge. Short segments relax side by side in NumPy; a segment of more than LONG characters
(an unbroken word such as encoded data) takes its edges from a heap, over linked neighbours, in about n log n steps.
Characters that are no piece fall back to bytes. Results of segments are kept in a bounded memo. (A shortest path over the edges would be the rule of unigram
models; it gives wrong results for byte-pair models, so the relaxation follows the merge rule.)

Cases: null and empty texts have no tokens; decoding gives the text back, except that U+2581, the mark itself, comes
back as a blank (`round_trip` compares with that). A model that isn't byte-pair, or changes texts before it cuts them, is
refused. Repeated rows each get a row; other columns of docs are carried along
where asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, flat, frugal, pieces as ranges, small_batches, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO = 300_000
#: Characters from which on a segment is relaxed by a heap.
LONG = 200
NONE = np.iinfo(np.int32).max


class Vocabulary:
    """What encoding and decoding need of a model: plain arrays, a few MB."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        text = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = [m.get_score(i) for i in plain]
        # a byte-pair model scores its pieces by the order of their merges, 0, -1, -2 ...; others by log-probabilities
        if any(x != int(x) or x > 0 for x in scores) or len(set(scores)) < len(scores) // 2:
            raise ValueError(f"{path} isn't a byte-pair model")
        odd = "a  \uff21\ufb01\u00bd "
        if m.decode(m.encode(odd)) != odd:
            raise ValueError(f"{path} changes texts before it cuts them")
        byte_of = {int(text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.bytes = np.array([byte_of.get(b, self.unknown) for b in range(256)], np.int32)
        letters = sorted({c for i in plain for c in text[i]})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.longest = max(len(text[i]) for i in plain)
        self.ids = np.array(plain, np.int32)
        self.length = np.array([len(text[i]) for i in plain])
        # equal scores share a rank; among equals the leftmost pair wins
        self.rank = np.unique([-m.get_score(i) for i in plain], return_inverse=True)[1].astype(np.int32)
        self.letters = len(letters)
        self.grid = np.zeros((len(plain), self.longest), np.uint16)
        for k, i in enumerate(plain):
            self.grid[k, : len(text[i])] = self.code[[ord(c) for c in text[i]]]
        inner = {text[i] for i in plain if MARK in text[i].lstrip(MARK)}
        long = {c for i in plain if len(text[i]) > 1 for c in text[i]}
        alone = "".join(c for c in "\n\t\r" if c not in long)
        self.pattern = f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+"
        if inner:
            raise ValueError("pieces with a mark after a letter aren't supported")
        spoken = [b"" if m.is_control(i) else bytes([int(text[i][3:5], 16)]) if m.is_byte(i) else " ⁇ ".encode() if m.is_unknown(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        self.size = np.array([len(s) for s in spoken], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(spoken), np.uint8)

    @staticmethod
    def keys(grid: np.ndarray) -> np.ndarray:
        grid = np.ascontiguousarray(grid)
        return grid.view(f"S{grid.itemsize * grid.shape[1]}").reshape(-1)


def suffix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of suffixes whose characters are packed in several numbers: by the first, and only where those tie by the others."""
    order = np.argsort(keys[0])
    first = keys[0][order]
    same = np.zeros(len(first), bool)
    same[1:] = first[1:] == first[:-1]
    same[:-1] |= same[1:].copy()
    tied = order[same]
    order[same] = tied[np.lexsort([k[tied] for k in reversed(keys)])]
    return order


def edges(code: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, place in the vocabulary) of every occurrence of every piece, sorted by position."""
    # the characters of this batch, in the same order; pieces with any other don't occur
    held = np.flatnonzero(np.bincount(code, minlength=v.letters + 2))
    held = held[held > 0]
    narrow = len(held) < 255
    kind, most = (">u1", 0xFF) if narrow else (">u2", 0xFFFF)
    small = np.zeros(v.letters + 2, kind)
    small[held] = np.arange(1, len(held) + 1)
    known = np.flatnonzero(((small[v.grid] > 0) | (v.grid == 0)).all(1))
    grid = small[v.grid[known]]
    size = -(-v.longest // 8) * 8
    padded = np.append(small[code], np.zeros(size, kind))
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, size)[: len(code)])
    array = suffix_order([suffixes.view(">u8")[:, k].astype(np.uint64) for k in range(suffixes.view(">u8").shape[1])])
    ordered = v.keys(suffixes)[array]
    pad = lambda fill: v.keys(np.pad(np.where(grid == 0, fill, grid).astype(kind), ((0, 0), (0, size - v.longest)), constant_values=fill))
    lo, hi = np.searchsorted(ordered, pad(0), "left"), np.searchsorted(ordered, pad(most), "right")
    n = hi - lo
    both = np.sort(array[flat(lo, n)] << 32 | np.repeat(known, n))
    piece = both & 0xFFFFFFFF
    return both >> 32, v.length[piece], piece


def relaxed(table: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols (begin, end) that one segment ends in; table has the piece (-1: none) at each place by length.

    The heap holds edges over two adjacent symbols by rank and place. An edge that comes up is used if two symbols still
    lie under it; a merge then offers the edges over the new symbol and its neighbours."""
    n, most = len(table), table.shape[1] - 1
    rank = memoryview(np.ascontiguousarray(ranks[table]).reshape(-1))
    none, width = int(NONE), table.shape[1]
    stop, start = list(range(1, n + 1)), list(range(-1, n))  # where the symbol at a place ends; where the one that ends there begins
    pairs = np.flatnonzero(ranks[table[: n - 1, 2]] != NONE)
    shift = max(n.bit_length(), 1)
    mask = (1 << shift) - 1
    heap = (((ranks[table[pairs, 2]].astype(np.int64) << shift | pairs) << 8) | 2).tolist()
    heapq.heapify(heap)
    while heap:
        key = heapq.heappop(heap)
        span, i = key & 255, key >> 8 & mask
        j = stop[i]
        if not 0 < j < n or stop[j] != i + span:
            continue
        k = i + span
        stop[i], stop[j], start[k] = k, 0, i
        before = start[i]
        if i and k - before <= most and (r := rank[before * width + k - before]) != none:
            heapq.heappush(heap, (r << shift | before) << 8 | (k - before))
        if k < n and (size := stop[k] - i) <= most and (r := rank[i * width + size]) != none:
            heapq.heappush(heap, (r << shift | i) << 8 | size)
    stops = np.array(stop, np.int64)
    starts = np.flatnonzero(stops)
    return starts, stops[starts]


def encoded_segments(segments: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the segments end to end, and how many each has."""
    joined = "".join(segments)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(n)
    # a segment ends in a place that no piece has
    code = np.zeros(len(points) + len(n), np.uint16)
    at = np.arange(len(points)) + np.repeat(np.arange(len(n)), n)
    code[at] = np.maximum(v.code[points], 1)
    position, length, piece = edges(code, v)
    # the piece that stands at a place with a length, by both
    table = np.full((len(code), v.longest + 1), -1, np.int32)
    table[position, length] = piece
    ranks = np.append(v.rank, np.int32(NONE))

    begin, end, own = at.copy(), at + 1, np.repeat(np.arange(len(n)), n)
    done = []
    long = np.flatnonzero(n > LONG)
    for i in long:
        lo = int(at[ends[i] - n[i]])
        starts, stops = relaxed(table[lo : lo + n[i]], ranks)
        done.append((starts + lo, stops + lo, np.full(len(starts), i)))
    if len(long):
        left = np.repeat(n <= LONG, n)
        begin, end, own = begin[left], end[left], own[left]
    while len(begin):
        span = end[1:] - begin[:-1]
        best = np.full(len(begin), NONE, np.int32)
        ok = (own[1:] == own[:-1]) & (span <= v.longest)
        i = np.flatnonzero(ok)
        best[i] = ranks[table[begin[i], span[i]]]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        least = np.minimum.reduceat(best, first)
        count = np.diff(np.append(first, len(begin)))
        ended = np.repeat(least == NONE, count)
        if ended.any():
            done.append((begin[ended], end[ended], own[ended]))
        hit = ~ended & (best == np.repeat(least, count))
        spot = np.flatnonzero(hit)
        spot = spot[np.append(True, own[spot][1:] != own[spot][:-1])] if len(spot) else spot
        end[spot] = end[spot + 1]
        keep = ~ended
        keep[spot + 1] = False
        begin, end, own = begin[keep], end[keep], own[keep]
    if not done:
        return np.zeros(0, np.int32), np.zeros(len(n), np.int64)
    begin, end, own = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(begin)
    begin, end, own = begin[order], end[order], own[order]
    ids = np.append(v.ids, np.int32(-1))[table[begin, end - begin]]
    fallen = np.flatnonzero(ids < 0)
    width = np.ones(len(ids), np.int64)
    if len(fallen):
        # symbols that are no piece are single characters: their bytes
        raw = [chr(c).encode("utf-8", "replace") for c in points[begin[fallen] - own[fallen]]]
        width[fallen] = [len(r) for r in raw]
        out = np.repeat(ids, width)
        out[out < 0] = v.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        ids = out
    return ids, np.bincount(own, width, len(n)).astype(np.int64)


class Encoder:
    """Encodes texts; remembers segments."""

    def __init__(self, v: Vocabulary):
        self.v, self.find = v, re.compile(v.pattern).findall
        self.clear()

    def clear(self):
        self.memo, self.ids, self.count = {}, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        cut = [self.find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set(chain.from_iterable(cut))
        fresh = [s for s in distinct if s not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.clear()
            fresh = list(distinct)
        if fresh:
            ids, count = encoded_segments(fresh, self.v)
            self.memo.update(zip(fresh, range(len(self.memo), len(self.memo) + len(fresh))))
            self.ids, self.count = [np.concatenate([*self.ids, ids])], [np.concatenate([*self.count, count])]
        n = np.array([len(c) for c in cut], np.int64)
        index = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        count = self.count[0]
        ids = self.ids[0][flat((np.cumsum(count) - count)[index], count[index])]
        tokens = np.append(0, np.cumsum(count[index]))[np.append(0, np.cumsum(n))]
        return ids, np.diff(tokens)


def decode(ids: np.ndarray, count: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The texts whose ids lie end to end."""
    size = v.size[ids]
    raw = v.pool[flat(v.start[ids], size)].tobytes()
    at = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
    return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def token_stage(known, tokens: bool):
    """Texts to their ids' number and digest, whether they come back, and with tokens the ids."""

    def stage(batches):
        v = known.value
        encoder = Encoder(v)
        for b in batches:
            texts = text_bytes(b.column("text"))
            # a batch of results for each piece of the texts; ids never become Python numbers
            for lo, hi in ranges(texts, PIECE):
                ids, count = encoder.encode([t.decode() if t else "" for t in texts[lo:hi]])
                ends = np.cumsum(count)
                digests = [hashlib.sha256(ids[e - n : e].astype("<i4").tobytes()).hexdigest() for e, n in zip(ends, count)]
                same = [back == (t or b"").replace(MARK.encode(), b" ") for back, t in zip(decode(ids, count, v), texts[lo:hi])]
                columns = [b.column("doc_id").slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "round_trip"]
                if tokens:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return stage


def tokenised(docs: DataFrame, model: str = MODEL, tokens: bool = False) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256 (of the ids as 4-byte little-endian numbers), round_trip; with tokens also the ids."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    return docs.select("doc_id", "text").mapInArrow(frugal(token_stage(known, tokens)), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * tokens)


def op9(spark, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"))

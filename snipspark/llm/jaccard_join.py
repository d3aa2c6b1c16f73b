"""N-gram Jaccard self-join by T-occurrence search with short and long inverted lists (DivideSkip), to classes of near-copies.

A document is the set of its 5-word shingles. Documents of the same normalised word sequence are one class, and only
classes are joined. To reach a Jaccard similarity of t, two sets of at least n elements share T >= t * n elements. Under
any fixed order of all shingles, leaving the last T - 1 elements of a set to the long lists, a partner must occur in
one of the n - T + 1 first, short lists. The order here is: shingles that aren't known as frequent, by hash; then the
frequent ones, rarest first. So the lists of passages that many documents share are long lists, which only the final
probing visits. Which shingles are frequent comes from counts over all documents and decides cost, never results.

1. Counts: each task counts its distinct shingles, key ranges add up; the most frequent (at most MOST) are broadcast.
2. Postings of the n - T + 1 first elements: lists of one class end here; the others are rows (shingle, class, n).
3. Searches: each list has a leader, the class with the largest share of frequent shingles, as the source of a group of
   near-copies has, and each class is searched by the best leader of its lists whose size allows a link. A search is DivideSkip over the inverted
   lists of the classes that it may reach (`Lists`): of the leader's lists the longest are set aside, the short ones are
   merged by a heap, classes that occur there often enough are probed in the long lists by binary search, and those that
   reach the required overlap stay. Lists whose members then form one component need nothing more.
4. In the lists that are left, members of different components have to be compared. Those of up to FEW members give
   pairs, unless the triangle inequality of the Jaccard distance, through a leader that both were probed by, or the number
   of short lists that the two share rules the pair out. Larger ones are joined to families; the members outside a family's main component are searches among
   blocks of all its members. Both go through the same DivideSkip searches and return links only.
5. Components by repeated star contraction in the shared folder; each document gets the least doc_id of its component.

Every pair that reaches the threshold is either found by a search or lies within a component already found, so
components are exact (up to collisions of 64-bit hashes of shingles and of word sequences: at 5e10 documents some tens of
false merges). Near-copies by the thousand cost one probe each; only those of them that aren't near their source are
searched for among all others, block by block.

Cases: null and empty texts have no shingles (n_shingles 0), are linked with nothing and keep their own doc_id; a text
of fewer than 5 words has one shingle, the whole sequence. Repeated rows each get a row. A null doc_id is never a
component's name unless all its documents have none. Other columns are ignored. An empty table gives an empty result.
Rows have no numbers, only their doc_id and a hash of their text, so nothing depends on how a scan is split.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, flat, frugal, frugal_group, joined, mixed, pieces, planes, ranges_for, small_batches, stored, taken, text_bytes, window_hashes, word_hashes
from .decontaminate import sized
from .substrings import by_part, rows, runs

SIZE = 5
#: The threshold as a fraction.
NUM, DEN = 80, 100
#: From this count on a shingle counts as frequent; how many of the most frequent are known to the tasks (8 bytes each).
FREQUENT, MOST = 8, 1 << 20
#: Bits of a shingle's hash that counts are kept by.
COUNT_BITS = 36
#: Shingles, and classes, that a task gathers before it sends them.
FLUSH, CLASSES = 2_000_000, 500_000
#: Entries of the rows that leave a task at once: a MB or two, as the JVM holds them outside its heap.
SENT = 100_000
#: Bits of the filter of classes that have postings in common with others: fixed, 4 MB.
FILTER_BITS = 1 << 25
#: Probes of one leader that go to one block.
STAR = 256

COUNTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.BinaryType())])
POSTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("cls", T.BinaryType()), T.StructField("size", T.BinaryType()), T.StructField("core", T.BinaryType())])
LISTS = "shingle long, cls long, size int, core int"
#: Members of a list that give pairs, and of a block.
FEW, BLOCK = 64, 512
#: Fixed value: weight of a long list's probe in the choice of how many lists are long.
MU = 0.0085
#: Entries of short lists that go through a heap; more are merged as sorted runs by NumPy.
HEAP = 4096


def classes_of(h: np.ndarray, at: np.ndarray) -> list[int | None]:
    """A signed 64-bit name for each text's sequence of word hashes; none for texts without words."""
    names = [xxhash.xxh3_64_intdigest(h[a:b].tobytes(), 7) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return [x - (1 << 64) if x and x >> 63 else x for x in names]


def fresh(h: np.ndarray, at: np.ndarray, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of the classes that weren't seen, where each one's begin, and their names."""
    names, new = classes_of(h, at), []
    for i, c in enumerate(names):
        if c is not None and c not in seen:
            seen.add(c)
            new.append(i)
    n = np.diff(at)[new]
    return h[flat(at[new], n)], np.append(0, np.cumsum(n)), np.array([names[i] for i in new], np.int64)


def windows(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts, given by their word hashes, end to end as they come, and where each text's begin."""
    n = np.diff(at)
    whole = np.maximum(n - SIZE + 1, 0)
    w = window_hashes(h, SIZE)[flat(at[:-1], whole)] if whole.any() else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < SIZE))
    if not len(short):
        return w, np.append(0, np.cumsum(whole))
    parts = np.split(w, np.cumsum(whole)[:-1])
    for d in short:
        parts[d] = window_hashes(h[at[d] : at[d + 1]], int(n[d]))
    return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


def shingled(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, end to end, and where each text's begin."""
    w, at = windows(h, at)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        w[a:b].sort()
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    return w[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(n))))


def count_stage(parts: int):
    """Texts to counts of their classes' shingles, by key range (a shingle counts as often as it stands in a text)."""
    bits = parts.bit_length() - 1

    def flush(found):
        key = taken(found)
        key.sort()
        starts, n = runs(key)
        key, n = key[starts], n.astype(np.uint32)
        del starts
        out, count = [], 0
        for p, s in by_part((key >> U64(COUNT_BITS - bits)).astype(np.int32)):
            out.append((p, planes(np.diff(key[s], prepend=U64(0))), planes(n[s])))
            count += s.stop - s.start
            if count >= SENT:
                yield from rows(COUNTS, out).to_batches()
                out, count = [], 0
        if out:
            yield from rows(COUNTS, out).to_batches()

    def stage(batches):
        seen, found, count = set(), [], 0
        for b in batches:
            texts = text_bytes(b.column("text"))
            for lo, hi in pieces(texts):
                h, at, _ = fresh(*word_hashes(texts[lo:hi]), seen)
                w, _ = windows(h, at)
                found.append(w >> U64(64 - COUNT_BITS))
                count += len(w)
                if count >= FLUSH or len(seen) >= CLASSES:
                    yield from flush(found)
                    count, seen = 0, set()
        if count:
            yield from flush(found)

    return stage


def frequent_stage(most: int):
    """The counts of one key range to its most frequent shingles."""

    def stage(table):
        key = np.concatenate([np.cumsum(joined([k], np.uint64)) for k in table.column("key").to_pylist()])
        n = joined(table.column("n").to_pylist(), np.uint32)
        order = np.argsort(key, kind="stable")
        starts, _ = runs(key[order])
        key, n = key[order][starts], np.add.reduceat(n[order].astype(np.int64), starts)
        many = np.flatnonzero(n >= FREQUENT)
        many = many[np.argsort(-n[many], kind="stable")][:most]
        return pa.table({"key": pa.array([key[many].tobytes()], pa.binary()), "n": pa.array([n[many].tobytes()], pa.binary())})

    return stage


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted count keys of the most frequent shingles, and their counts: at most MOST."""
    parts = ranges_for(docs)
    found = docs.select("text").mapInArrow(frugal(count_stage(parts)), COUNTS).groupBy("part").applyInArrow(frugal_group(frequent_stage(max(1, MOST // parts))), "key binary, n binary").collect()
    key = np.concatenate([np.frombuffer(r["key"], np.uint64) for r in found] or [np.empty(0, np.uint64)])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in found] or [np.empty(0, np.int64)])
    order = np.argsort(key)
    return key[order], n[order]


def least_shared(n):
    """T: how many elements a set of n shares at least with any partner."""
    return -(-NUM * n // DEN)


def posting_stage(parts: int, known):
    """Texts to the postings of their short lists, by key range; a class once for each task's gathering."""
    bits = parts.bit_length() - 1

    def flush(found):
        key, cls, size, core = (taken(x) for x in found)
        order = np.argsort(key, kind="stable")
        key, cls, size, core = key[order], cls[order], size[order], core[order]
        del order
        out, count = [], 0
        for p, s in by_part((key >> U64(64 - bits)).astype(np.int32)):
            out.append((p, planes(key[s]), planes(cls[s]), planes(size[s]), core[s].tobytes()))
            count += s.stop - s.start
            if count >= SENT:
                yield from rows(POSTS, out).to_batches()
                out, count = [], 0
        if out:
            yield from rows(POSTS, out).to_batches()

    def stage(batches):
        often, times = known.value
        seen, found, count = set(), ([], [], [], []), 0
        for b in batches:
            texts = text_bytes(b.column("text"))
            for lo, hi in pieces(texts):
                h, at, names = fresh(*word_hashes(texts[lo:hi]), seen)
                w, at = shingled(h, at)
                n = np.diff(at)
                rank = np.zeros(len(w), np.int64)
                if len(often):
                    low = w >> U64(64 - COUNT_BITS)
                    i = np.minimum(np.searchsorted(often, low), len(often) - 1)
                    rank = np.where(often[i] == low, times[i], 0)
                doc = np.repeat(np.arange(len(n)), n)
                # the share of frequent shingles, in 255ths
                core = (255 * np.bincount(doc, rank > 0, len(n)) // np.maximum(n, 1)).astype(np.uint8)
                for d in np.flatnonzero(np.bincount(doc, rank > 0, len(n))):
                    a, b = at[d], at[d + 1]
                    w[a:b] = w[a:b][np.argsort(rank[a:b], kind="stable")]
                place = np.arange(len(w)) - np.repeat(at[:-1], n)
                short = place < np.repeat(n - least_shared(n) + 1, n)
                own = doc[short]
                for gathered, x in zip(found, (w[short], names[own], n[own].astype(np.uint32), core[own])):
                    gathered.append(x)
                count += len(own)
                if count >= FLUSH or len(seen) >= CLASSES:
                    yield from flush(found)
                    seen, count = set(), 0
        if count:
            yield from flush(found)

    return stage


def list_stage(table):
    """The postings of one key range to the lists of two classes and more."""
    key, cls, size = joined(table.column("key").to_pylist(), np.uint64), joined(table.column("cls").to_pylist(), np.int64), joined(table.column("size").to_pylist(), np.uint32)
    core = np.frombuffer(b"".join(table.column("core").to_pylist()), np.uint8)
    order = np.argsort(key, kind="stable")
    starts, n = runs(key[order])
    order = order[np.repeat(n > 1, n)]
    order = order[np.lexsort((cls[order], key[order]))]
    key, cls, size, core = key[order], cls[order], size[order], core[order]
    starts, _ = runs(key, cls)
    key, cls, size, core = key[starts], cls[starts], size[starts], core[starts]
    _, n = runs(key)
    many = np.repeat(n > 1, n)
    return pa.table({"shingle": pa.array(key[many].view(np.int64)), "cls": pa.array(cls[many]), "size": pa.array(size[many].astype(np.int32)), "core": pa.array(core[many].astype(np.int32))})


def filter_bits(cls: np.ndarray) -> np.ndarray:
    x = mixed(cls.view(np.uint64))
    return np.stack([x & U64(FILTER_BITS - 1), x >> U64(39)])


def in_filter(bits: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return np.all([bits[i >> U64(3)] >> (U64(7) - (i & U64(7))).astype(np.uint8) & 1 for i in filter_bits(cls)], axis=0)


def class_filter(lists: DataFrame) -> np.ndarray:
    """A Bloom filter of the classes in lists, of a fixed size: tasks set bits, the driver unites the bytes."""

    def stage(batches):
        held = np.zeros(FILTER_BITS, bool)
        for b in batches:
            held[filter_bits(b.column("cls").to_numpy()).reshape(-1)] = True
        packed = np.packbits(held).reshape(-1, 1 << 16)
        for i in np.flatnonzero(packed.any(1)):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "bits": pa.array([packed[i].tobytes()], pa.binary())})

    def unite(table):
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"i": table.column("i").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((FILTER_BITS >> 19, 1 << 16), np.uint8)
    for r in lists.select("cls").distinct().mapInArrow(frugal(stage), "i int, bits binary").groupBy("i").applyInArrow(frugal_group(unite), "i int, bits binary").collect():
        out[r["i"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def class_stage(chosen):
    """Each document's class and number of shingles, and its text if its class may be in lists."""

    def stage(batches):
        bits = chosen.value
        for b in batches:
            texts, ids, keys = text_bytes(b.column("text")), b.column("doc_id"), b.column("key")
            names, sizes, keep = [], [], []
            for lo, hi in pieces(texts):
                h, at = word_hashes(texts[lo:hi])
                sizes.append(np.diff(shingled(h, at)[1]))
                found = classes_of(h, at)
                hit = in_filter(bits, np.array([c or 0 for c in found], np.int64))
                keep += [b" ".join(t.lower().split()) if c is not None and k else None for t, c, k in zip(texts[lo:hi], found, hit)]
                names += found
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array(names, pa.int64()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(keep, pa.binary())], ["key", "doc_id", "cls", "n_shingles", "words"])

    return stage


def merged(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of sorted lists that occur at least `need` times, in order, and how often."""
    if sum(map(len, lists)) <= HEAP:
        times = Counter(heapq.merge(*(x.tolist() for x in lists)))
        often = [i for i, n in times.items() if n >= need]
        return np.array(often, np.int64), np.array([times[i] for i in often], np.int64)
    every = np.concatenate(lists)
    every.sort(kind="stable")
    starts, n = runs(every)
    return every[starts][n >= need], n[n >= need]


class Lists:
    """Inverted lists of the members of a block, and the T-occurrence search in them (DivideSkip)."""

    def __init__(self, w: np.ndarray, at: np.ndarray):
        self.size = np.diff(at)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(w, kind="stable")
        self.start, self.length = runs(w[order])
        self.name, self.member = w[order][self.start], owner[order]
        self.probes = 0

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members that the short lists leave for a set q of shingles, the overlaps that probing gives them, and whether
        those reach the threshold. Members that aren't among them can't reach it."""
        none = np.zeros(0, np.int64)
        t = int(least_shared(len(q)))
        if not len(self.name):
            return none, none, none.astype(bool)
        i = np.minimum(np.searchsorted(self.name, q), len(self.name) - 1)
        i = i[self.name[i] == q]
        if len(i) < t:
            return none, none, none.astype(bool)
        i = i[np.argsort(self.length[i], kind="stable")]
        # the longest lists are set aside: a member that all of them hold still needs t - n_long of the others
        n_long = min(t - 1, int(t / (MU * np.log(max(self.length[i[-1]], 2)) + 1)))
        short, long = i[: len(i) - n_long], i[len(i) - n_long :]
        found, count = merged([self.member[self.start[k] : self.start[k] + self.length[k]] for k in short], t - n_long)
        if n_long and len(found):
            # all long lists end to end, each in a number range of its own: one binary search a list and member
            span, own = len(self.size), np.arange(n_long)
            entries = self.member[flat(self.start[long], self.length[long])] + np.repeat(own, self.length[long]) * span
            wanted = (own[:, None] * span + found[None]).reshape(-1)
            place = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
            count = count + (entries[place] == wanted).reshape(n_long, -1).sum(0)
            self.probes += len(wanted)
        return found, count, DEN * count >= NUM * (len(q) + self.size[found] - count)


def probe_stage(table):
    """The searches of a block (a leader, the classes it may reach, all with their words) to the numbers of shared and of all shingles; classes that the short lists rule out have -1 shared ones."""
    a, star, b, words = table.column("a").to_numpy(), table.column("star").to_numpy(), table.column("b").to_numpy(), table.column("words").to_pylist()
    _, first, row = np.unique(b, return_index=True, return_inverse=True)
    w, at = shingled(*word_hashes([words[i] for i in first]))
    size, out = np.diff(at), []
    order = np.lexsort((a != b, star, a))
    starts, n = runs(a[order], star[order])
    for lo, k in zip(starts, n):
        lead, others = row[order[lo]], row[order[lo + 1 : lo + k]]
        lists = Lists(w[flat(at[others], size[others])], np.append(0, np.cumsum(size[others])))
        found, count, _ = lists.search(w[at[lead] : at[lead + 1]])
        same = np.full(len(others), -1, np.int64)
        same[found] = count
        out.append((np.full(len(others), a[order[lo]]), b[order[lo + 1 : lo + k]], same, np.where(same < 0, 0, size[lead] + size[others] - same)))
    a, b, same, united = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((),) * 4))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "same": pa.array(same, pa.int64()), "united": pa.array(united, pa.int64())})


def words_of(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, words) of the classes that are wanted (column cls), and of some that the filter lets through: those texts alone are shuffled."""
    chosen = classes.sparkSession.sparkContext.broadcast(class_filter(wanted))
    held = F.arrow_udf(lambda cls: pa.array(in_filter(chosen.value, cls.to_numpy(zero_copy_only=False)).astype(bool)), T.BooleanType())
    return classes.where("words is not null").where(held("cls")).groupBy("cls").agg(F.first("words").alias("words"))


def size_fits(x: str, y: str):
    """Whether sets of these sizes can reach the threshold."""
    return DEN * F.least(x, y) >= NUM * F.greatest(x, y)


def probed(pairs: DataFrame, classes: DataFrame, blocks: int) -> DataFrame:
    """(a, b, same, united) of pairs of classes (a, b), by searches for a. Its words go once to each block of its pairs, of which a leader of many has many."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("stars"))
    pairs = pairs.join(many, "a").withColumn("star", F.pmod(F.col("b"), F.col("stars")))
    block = F.pmod(F.xxhash64("a", "star"), F.lit(blocks)).cast("int").alias("block")
    leads = pairs.select("a", "star").distinct()
    sides = pairs.select("a", "star", "b").unionByName(leads.select("a", "star", F.col("a").alias("b")))
    texts = words_of(classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")))
    full = sides.join(texts.withColumnRenamed("cls", "b"), "b").select(block, "a", "star", "b", "words")
    return stored(full.groupBy("block").applyInArrow(frugal_group(probe_stage), "a long, b long, same long, united long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(cls, root) for every class in links (a, b): the least class it is connected with, by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = stored(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        last, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    named = edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
    return named.unionByName(named.select(F.col("root").alias("cls"), "root").distinct())


def is_link():
    return DEN * F.col("same") >= NUM * F.col("united")


def block_stage(table):
    """Two blocks of a family, each class with its component and whole words, to links between components: the first block's classes are searched for among the second's; a class gives one link for each component there."""
    side, cls, root, words = (table.column(c).to_pylist() for c in ("side", "cls", "root", "words"))
    w, at = shingled(*word_hashes(words))
    size, out = np.diff(at), []
    cls, root, first = np.array(cls, np.int64), np.array(root, np.int64), np.array(side) == 0
    own = np.flatnonzero(~first)
    lists = Lists(w[flat(at[own], size[own])], np.append(0, np.cumsum(size[own])))
    for i in np.flatnonzero(first):
        found, _, reaches = lists.search(w[at[i] : at[i + 1]])
        near = own[found[reaches]]
        near = near[root[near] != root[i]]
        _, one = np.unique(root[near], return_index=True)
        out += [(cls[i], cls[j]) for j in near[one]]
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def in_blocks(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between members of different components within the families of large lists. All members of a list are one family."""
    family = components(lists.select(F.col("cls").alias("a"), F.col("lead_cls").alias("b"))).withColumnRenamed("root", "family")
    held = stored(lists.groupBy("cls").agg(F.first("root").alias("root")).join(family, "cls"))
    roots = held.groupBy("family", "root").agg(F.count("*").alias("n"))
    main = roots.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("in_main"))
    main = main.select("family", "main", F.ceil(F.col("all") / BLOCK).alias("columns"), F.greatest(F.ceil((F.col("all") - F.col("in_main")) / BLOCK), F.lit(1)).alias("rows"))
    spread = held.join(main, "family")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    strangers = spread.where("root <> main").select("family", "cls", "root", F.lit(0).alias("side"), block("rows").alias("i"), upto("columns").alias("j"))
    everyone = spread.select("family", "cls", "root", F.lit(1).alias("side"), upto("rows").alias("i"), block("columns").alias("j"))
    cells = strangers.unionByName(everyone).join(words_of(classes, held), "cls")
    return stored(cells.groupBy("family", "i", "j").applyInArrow(frugal_group(block_stage), "a long, b long"))


def first_pivots(probes: DataFrame) -> DataFrame:
    """(cls, pivot, far): for each probed class a leader it was compared with, the one of most probes, and the Jaccard distance; a leader is at 0 from itself."""
    probes = probes.where("same >= 0")
    sides = probes.select(F.col("a").alias("pivot"), F.col("b").alias("cls"), (1 - F.col("same") / F.col("united")).alias("far"))
    sides = sides.unionByName(probes.select(F.col("b").alias("pivot"), F.col("a").alias("cls"), (1 - F.col("same") / F.col("united")).alias("far")))
    often = sides.groupBy("pivot").agg(F.count("*").alias("n"))
    sides = sides.join(often, "pivot").unionByName(often.select("pivot", F.col("pivot").alias("cls"), F.lit(0.0).alias("far"), "n"))
    return sides.groupBy("cls").agg(F.max_by(F.struct("pivot", "far"), F.struct("n", "pivot")).alias("p")).select("cls", "p.pivot", "p.far")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """For each row: key (a hash of its text), doc_id, cls (its class; null without words), n_shingles, component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = ranges_for(docs)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    known = spark.sparkContext.broadcast(frequent(docs))
    lists = stored(docs.select("text").mapInArrow(frugal(posting_stage(parts, known)), POSTS).groupBy("part").applyInArrow(frugal_group(list_stage), LISTS))
    chosen = spark.sparkContext.broadcast(class_filter(lists))
    classes = stored(keyed.mapInArrow(frugal(class_stage(chosen)), "key long, doc_id long, cls long, n_shingles long, words binary"))

    best = F.struct("core", -F.col("cls"))
    leaders = lists.groupBy("shingle").agg(F.max_by(F.struct("core", F.col("cls").alias("a"), "size"), best).alias("lead"))
    led = lists.join(leaders, "shingle").where(size_fits("size", "lead.size"))
    # a leader's own best leader is itself: it is probed by the others only
    pairs = led.groupBy("cls").agg(F.max_by("lead.a", F.struct("lead.core", -F.col("lead.a"))).alias("a")).where("a <> cls")
    pairs = pairs.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()
    probes = probed(stored(pairs), classes, parts)
    links = probes.where(is_link()).select("a", "b")
    found = stored(components(links))

    # what is left: lists of several components
    tagged = lists.join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = tagged.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members"), F.max_by(F.struct("cls", "root"), best).alias("lead")).where("least <> most")
    open_ = stored(tagged.join(several.select("shingle", "members", F.col("lead.cls").alias("lead_cls"), F.col("lead.root").alias("lead")), "shingle").drop("core"))
    unseen = open_.where(F.col("members") > FEW).groupBy("cls").agg(F.count("*").alias("unseen"))
    members = stored(open_.where(F.col("members") <= FEW).join(first_pivots(probes), "cls", "left").join(unseen, "cls", "left"))
    x, y = members.where("root <> lead").alias("x"), members.alias("y")
    near = 1 - NUM / DEN + 1e-9
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.lead")) | (F.col("x.cls") < F.col("y.cls")))
    could = F.coalesce((F.col("x.pivot") != F.col("y.pivot")) | (F.abs(F.col("x.far") - F.col("y.far")) <= near), F.lit(True)) & size_fits("x.size", "y.size")
    # two sets share what their short lists share (a row here for each, and at most all lists of more than FEW) and at most T - 1 elements behind
    most = F.least(F.coalesce("x.unseen", F.lit(0)), F.coalesce("y.unseen", F.lit(0))) + F.ceil(NUM * F.greatest("x.size", "y.size") / DEN) - 1
    rest = x.join(y, apart & could).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), most.alias("most"), (F.col("x.size") + F.col("y.size")).alias("both"))
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("most").alias("most"), F.first("both").alias("both")).where((NUM + DEN) * (F.col("shared") + F.col("most")) >= NUM * F.col("both")).select("a", "b")
    rest = stored(rest.join(probes.select("a", "b"), ["a", "b"], "left_anti"))
    links = links.unionByName(probed(rest, classes, parts).where(is_link()).select("a", "b"))
    large = open_.where(F.col("members") > FEW)
    if large.limit(1).count():
        links = links.unionByName(in_blocks(large, classes))
    final = components(links)

    own = classes.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = own.join(final, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(ids, "root").select("cls", "component_id")
    return classes.drop("words").join(names, "cls", "left").select("key", "doc_id", "cls", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the document of the least doc_id (of several texts of that id the one of the least hash, of
    several rows with it one); rows without words all stay, and so do the rows of a component in which all doc_ids are null.

    Rows are told apart by doc_id and a hash of the text, which every scan gives alike. Rows that are alike in both are
    equal here: the one that stays is picked among them."""
    given = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("key"), F.col("doc_id").alias("id"))
    groups = stored(jaccard_join(docs).where("cls is not null and component_id is not null").groupBy("component_id", "doc_id", "key").agg(F.count("*").alias("n")))
    best = groups.where("doc_id = component_id").groupBy("component_id").agg(F.min(F.struct("key", "n")).alias("m")).select(F.col("component_id").alias("id"), "m.key", "m.n")
    gone = stored(groups.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).join(best, F.col("gone_id").eqNullSafe(F.col("id")) & (F.col("gone_key") == F.col("key")), "left_anti"))
    again = stored(best.where("n > 1").select("id", "key"))
    twice = sized(gone.unionByName(again.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"))))
    left = given.join(twice, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    one = given.join(sized(again), ["id", "key"]).groupBy("id", "key").agg(F.first("row").alias("row"))
    return left.select("row.*").unionByName(one.select("row.*"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(ws) - 5, 0) + 1), lambda k: array_to_string(ws[k + 1:k + 5], ' '))) AS g FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT r.doc_id, l.y AS m FROM r JOIN l ON l.x = r.m)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, CAST(min(m) AS BIGINT) AS component_id FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

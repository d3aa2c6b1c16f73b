"""The operators against plain Python on small tables with nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import gzip
import hashlib
import io
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipspark.llm import chat, common, decontaminate, jaccard_join, langid, pieces, quality, sharding, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, bucket int"
WORD1 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def texts():
    """Copies, near-copies, shared passages, short, empty, null, long and odd texts; a doc_id that repeats, one that is null."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(300)] + ["Été", "Ö", "naïve", "the", "The"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = make(45)
    base = make(130)
    out = [" ".join(make(rng.randrange(1, 90))) for _ in range(40)]
    out += [" ".join(make(20) + passage + make(rng.randrange(5, 30))) for _ in range(12)]
    for _ in range(14):
        near = list(base)
        for _ in range(rng.randrange(0, 5)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(" ".join(near))
    out += [" ".join(base), " ".join(base).upper(), "\n".join(base), "", None, "one", "a b c d", "a b c d", "x " * 60, " \t\n", "word joined   wide", " ".join(make(6000)), "# $ % <b> # # # $ $ $"]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "clash", 1) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, rows[41][1], None, None, None, None, None), (None, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def words1(t):
    return WORD1.findall(lowered(t)) if t else []


def contamination(given, items):
    want = []
    for d, t in given:
        w, hit, found = words1(t), set(), set()
        for item, phrase in items:
            x = words1(phrase)
            if item is None or not x:
                continue
            size = min(13, len(x))
            for k in range(len(x) - size + 1):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[k : k + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        want.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return want


def test_decontaminate(spark, docs, nothing):
    given = pairs_of(docs)
    ws = [words1(t) for _, t in given]
    long = [w for w in ws if len(w) > 40]
    items = [(1, " ".join(long[0][3:30])), (2, " ".join(long[1][:13]).upper()), (3, "a b c d"), (4, None), (5, ""), (None, "one"), (10, " ".join(long[0][5:20])), (2, "one"), (6, "never seen words here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(given, items)
    got = decontaminate.decontaminate(docs, table).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("item_ids", ","), "contaminated").collect()
    assert multiset(got) == multiset(want)
    assert decontaminate.clean(docs, table).count() == sum(not x[5] for x in want) and decontaminate.clean(docs, table).columns == docs.columns
    assert decontaminate.decontaminate(nothing, table).count() == 0
    assert decontaminate.decontaminate(docs, table.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha x x x beta gamma")], "doc_id long, text string")
    phrases = decontaminate.item_windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = decontaminate.build_index(d, phrases.select(F.explode("terms").alias("term")))
    at = lambda slop: {r["doc_id"] for r in decontaminate.phrase_matches(index, phrases, slop).join(index.select("uid", "doc_id").distinct(), "uid").collect()}
    assert at(0) == {2} and at(1) == {1, 2}


def removals(given):
    """(doc_id, words, removed, kept words) by comparing all windows."""
    key = lambda d: (d is None, d or 0)
    first, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in given]
    for (d, _), w in zip(given, words):
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            first[k] = min(first.get(k, ((True, 1 << 62), 0)), (key(d), p))
    out = []
    for (d, _), w in zip(given, words):
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (key(d), p) for q in range(p, p + 20)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings(docs, nothing):
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in removals(pairs_of(docs))]
    got = substrings.dedup_substrings(docs).select("rest.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert multiset(got) == multiset(want) and any(r["n_removed"] for r in got)
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert substrings.dedup_substrings(nothing).count() == 0


def test_small_batches_change_nothing(spark, docs):
    """Batches of any size give the same rows; a bound that the session has stays."""
    before = spark.conf.get(common.BATCH_KEY, None)
    results = []
    try:
        for bound in (2000, 64 << 20):
            spark.conf.set(common.BATCH_KEY, str(bound))
            common.small_batches(spark)
            assert spark.conf.get(common.BATCH_KEY) == str(bound)
            results.append([multiset(substrings.dedup_substrings(docs).drop("rest").collect()), multiset(jaccard_join.jaccard_join(docs).collect()), multiset(pieces.tokenised(docs, tokens=True).drop("ids").collect())])
        spark.conf.unset(common.BATCH_KEY)
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_KEY) == str(common.BATCH_BYTES)
    finally:
        spark.conf.unset(common.BATCH_KEY)
        if before is not None:
            spark.conf.set(common.BATCH_KEY, before)
    assert results[0] == results[1]


def shingles(t):
    w = lowered(t or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(given):
    sets = [shingles(t) for _, t in given]
    parent = list(range(len(given)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(given)):
        groups[top(i)].append(given[i][0])
    return [(d, len(s), min((x for x in groups[top(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(given, sets))]


@pytest.mark.parametrize("few", [64, 2])
def test_jaccard_join(docs, nothing, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)  # small lists go through blocks too
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    got = jaccard_join.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert multiset(got) == multiset(components(pairs_of(docs)))
    if few == 64:
        left = jaccard_join.one_of_each(docs)
        ids = collections.Counter(r["doc_id"] for r in left.collect())
        heads = {c for d, n, c in components(pairs_of(docs)) if n}
        assert {d for d in ids if d is not None} >= {h for h in heads if h is not None} and max(ids[h] for h in heads if h is not None) == 1
        assert jaccard_join.jaccard_join(nothing).count() == 0


def test_word_hashes():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abCDéx\0-") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 255, 256, 257, 600])))
    texts = [None, "", " \t", *("".join(word()[: rng.choice([3, 700])] + rng.choice(" \n\t\r\x0b\x0c\x1c") * rng.randrange(1, 3) for _ in range(60)) for _ in range(60)), "x", ""]
    texts = [t.encode() if t is not None else None for t in texts]
    words = [t.lower().split() if t else [] for t in texts]
    h, at = common.word_hashes(texts)
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))
    assert common.word_hashes([])[1].tolist() == [0] and common.word_hashes([b"AB  c"])[0].tolist() == common.word_hashes([b"c ab"])[0][::-1].tolist()


def test_jaccard_join_compares_no_texts_that_share_a_passage_alone(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for g in range(30):  # a passage in texts of four sizes, another one in three texts of one size
        some, more = words(15), words(15)
        rows += [words(n) + some + words(n) for n in (40, 60, 90, 140)] + [words(60) + more + words(60) for _ in range(3)]
    rows += [[*r[:-1], "other"] for r in rows[:5]]
    asked, probed = [], jaccard_join.probed
    monkeypatch.setattr(jaccard_join, "probed", lambda pairs, *more: asked.append(pairs.count()) or probed(pairs, *more))
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert multiset(got) == multiset(components(pairs_of(docs)))
    # the first searches are of a leader for texts of its size alone, the others for what may still reach the threshold
    assert asked[0] <= 5 + 30 * 2 and asked[1] <= 5


def test_t_occurrence_search():
    rng = random.Random(8)
    base = rng.sample(range(1 << 40), 120)
    sets = []
    for i in range(150):
        if i % 3 == 0:
            x = rng.sample(range(1 << 40), rng.randrange(1, 60))
        else:
            x = [y for y in base if rng.random() > 0.3 * (i % 7) / 7] + rng.sample(range(1 << 40), rng.randrange(20))
        sets.append(np.unique(np.array(x, np.uint64)))
    at = np.append(0, np.cumsum([len(x) for x in sets]))
    for heap in (1 << 30, 0):
        jaccard_join.HEAP, before = heap, jaccard_join.HEAP
        lists = jaccard_join.Lists(np.concatenate(sets), at)
        probed = 0
        for q in [*sets, np.array(sorted(base), np.uint64), np.array([7], np.uint64)]:
            probes = lists.probes
            found, count, reaches = lists.search(q)
            shared = [len(set(q.tolist()) & set(x.tolist())) for x in sets]
            want = [i for i, x in enumerate(sets) if 100 * shared[i] >= 80 * (len(q) + len(x) - shared[i])]
            assert found[reaches].tolist() == want and count.tolist() == [shared[i] for i in found]
            probed += lists.probes - probes
            # only what the short lists leave is probed, at most once in each of fewer than T long lists
            assert lists.probes - probes <= len(found) * (jaccard_join.least_shared(len(q)) - 1)
        assert probed
        found, _, _ = lists.search(np.unique(np.array(base, np.uint64)))
        assert len(found) and all(i % 3 for i in found)
        jaccard_join.HEAP = before


def around(spark, make, action):
    """A lazy result made with one split of the scans and run with another."""
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        lazy = make()
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        return action(lazy)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_rows_keep_their_identity_whatever_the_split(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(30)] for _ in range(40)]
    rows = [(i, " ".join(base[i % 40]), "en", "s", 1) for i in range(400)] + [(0, " ".join(base[0]), "en", "again", 1)] + [(1000 + i, " ".join(word() for _ in range(30)), "en", "s", 1) for i in range(600)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    read = lambda: spark.read.parquet(path)
    items = [(i, " ".join(base[i])) for i in range(20)]
    bad = {r[0] for r in contamination([(d, t) for d, t, *_ in rows], items) if r[5]}
    assert len(bad) == 200
    got = around(spark, lambda: decontaminate.clean(read(), spark.createDataFrame(items, "item_id long, text string")), lambda x: x.collect())
    assert multiset((r["doc_id"],) for r in got) == multiset((r[0],) for r in rows if r[0] not in bad)
    got = around(spark, lambda: jaccard_join.one_of_each(read()), lambda x: x.collect())
    assert sorted(r["doc_id"] for r in got) == [*range(40), *range(1000, 1600)]
    pages = lambda: read().select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    got = around(spark, lambda: warc.page_records(pages()), lambda x: x.collect())
    assert len(got) == len(rows) and sum(r["record_type"] == "response" for r in got) == 640
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") and r["refers_to"] != r["record_id"] for r in got)


def test_quality(docs, nothing):
    want = []
    for d, t in pairs_of(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 2 * len(again) > len(w)))
    got = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert multiset(got) == multiset(want)
    assert quality.quality(docs).where("base_failed and kept").count() == 0 and quality.quality(nothing).count() == 0


def languages(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "th", "ing", "er", "wh", "on"], "de": ["der", "sch", "ung", "ein", "ich", "ü"], "fr": ["le", "eau", "ment", "é", "oi", "qu"], "es": ["el", "ción", "os", "rr", "ñ", "ado"]}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 4]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(30)), lang))
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "123 -- 456", "en"), (902, rows[0][1], None)], "doc_id long, text string, lang string")


def test_language_id(spark, nothing):
    d = languages(spark)
    model = langid.fit(langid.learned(d), 60)
    got = {r["row"]["doc_id"]: r for r in langid.predict(d, model).collect()}
    held = [r for r in d.where(langid.held_out() & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]")).collect()]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == sorted(("en", "de", "fr", "es"))[0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["lang_pred"] == "und" for r in langid.predict(d.limit(3), langid.fit(nothing)).collect())
    assert langid.predict(nothing, model).count() == 0
    odd = spark.createDataFrame([(1, "½ ² ①", "x", 5), (2, "ª 1", "x", 5), (3, None, "x", 5), (4, "the thing " * 60000, "x", 5), (5, "le eau qu", "x", 5), (5, "le eau qu", "x", 5)], "doc_id long, text string, row string, score int")
    seen = langid.predict(odd, model).select("row.doc_id", "lang_pred").collect()
    assert multiset((r["doc_id"], r["lang_pred"] == "und") for r in seen) == multiset([(1, True), (2, False), (3, True), (4, False), (5, False), (5, False)])
    given = d.withColumn("lang", F.when(F.col("doc_id") == 5, F.lit("xx")).otherwise(F.col("lang"))).withColumn("score", F.lit(1))
    kept = langid.identified(given)
    assert kept.columns == given.columns and {r["doc_id"] for r in kept.collect()} == {*range(240), 902}
    assert kept.where("doc_id = 902").first()["lang"] == "de" and langid.identified(given, 1.1).count() == 0
    assert langid.identified(nothing).count() == 0


def test_toxicity(spark, nothing):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["an", "the", "er", "on", "re", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [rng.choice(plain) for _ in range(60)] + ([rng.choice(["vexo", "vexlo"]) + rng.choice(plain) for _ in range(3)] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (2000, None), (2001, "")], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (2000, 0), (5000, None), (None, 1)], "doc_id long, toxic int")
    test = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(d.where(~out), y.where(~F.coalesce(out, F.lit(False))))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, model).collect()}
    held = [i for i in range(900) if test(i)]
    right = sum((got[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95 and got[2000] < 0.5 and got[2001] < 0.5
    none = toxicity.fit(nothing, y.where("false"))
    assert {r["score"] for r in toxicity.toxicity(d.limit(5), none).collect()} == {0.0}
    assert toxicity.toxicity(nothing, model).count() == 0


def test_toxicity_by_hand(spark):
    """Counts, probabilities and scores by plain loops; both classes' probabilities add up to one."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 5))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)) + ["vexing"] * (i % 4 == 0) + ["Vexed!"] * (i % 8 == 0))) for i in range(300)]
    labels = {i: int(i % 4 == 0) for i in range(200)}
    d = spark.createDataFrame([*rows, (900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1])], "doc_id long, text string").repartition(3)
    y = spark.createDataFrame([*labels.items(), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    sets = {i: set(re.findall("[a-z]+", t.lower())) for i, t in rows}
    n = [collections.Counter(w for i, l in labels.items() if l == c for w in sets[i]) for c in (0, 1)]
    t, k = [sum(c.values()) for c in n], [len(c) for c in n]
    known = set(n[0]) | set(n[1])
    assert (model.totals["t0"], model.totals["t1"], model.totals["k0"], model.totals["k1"], model.totals["v"]) == (*t, *k, len(known))

    def p(c, a):
        bg = max((a[0] > 0) + (a[1] > 0) - 0.75, 0) / sum(k) + 0.75 * len(known) / sum(k) / (len(known) + 1)
        return max(a[c] - 0.75, 0) / t[c] + 0.75 * k[c] / t[c] * bg

    for c in (0, 1):
        assert math.isclose(sum(p(c, (n[0][w], n[1][w])) for w in known) + p(c, (0, 0)), 1)
    a = np.array([(n[0][w], n[1][w]) for w in known])
    assert np.allclose([x.sum() + p(c, (0, 0)) for c, x in enumerate(toxicity.probabilities(a[:, 0], a[:, 1], model.totals))], 1)

    def row(i, label=None):
        v = [math.log(p(1, x) / p(0, x)) for x in ((n[0][w] - (label == 0), n[1][w] - (label == 1)) for w in sets[i])]
        return [sum(v) / len(v), *(sorted(v, reverse=True) + [0, 0, 0])[:3]]

    seen = toxicity.scored(d.where("doc_id < 200").withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int")), model, "toxic").collect()
    assert np.allclose(sorted((r["toxic"], *r["y"]) for r in seen), sorted((labels[i], *row(i, labels[i])) for i in labels))
    w = model.weights
    got = collections.defaultdict(list)
    for r in toxicity.toxicity(d, model).collect():
        got[r["doc_id"]].append(r["score"])
    assert all(math.isclose(got[i][0], 1 / (1 + math.exp(-(np.dot(row(i), w[:-1]) + w[-1]))), rel_tol=1e-9) for i in sets)
    assert got[902] == [got[0][0]] * 2 and got[900] == got[901]


def test_toxicity_learns_rare_words(spark):
    """Words of one class in a few texts each, among many ordinary words; long texts."""
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefghilmnorst") for _ in range(n))
    plain, marks = [make(rng.randrange(3, 10)) for _ in range(3000)], [make(9) for _ in range(40)]
    text = lambda bad: " ".join(rng.choices(plain, k=rng.randrange(40, 2000)) + rng.sample(marks, 2) * bad)
    d = spark.createDataFrame([(i, text(i % 5 == 0)) for i in range(500)], "doc_id long, text string").repartition(4)
    model = toxicity.fit(d, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int"))
    asked = spark.createDataFrame([(i, text(i % 2)) for i in range(60)], "doc_id long, text string")
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 2) for r in toxicity.toxicity(asked, model).collect()) >= 57


def test_chat(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, **({"depends_on": d} if d else {})} for i, n, a, d in calls]})
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi {"), (1, 2, "assistant", call(("a", "add", {"y": 2, "x": 1}, None), ("b", "add", {"x": "1"}, ["a"]), ("c", "none", {}, ["zz"]))),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [1]}})), (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "again"})), (1, 5, "tool", json.dumps({"tool_call_id": "q"})),
        (2, 0, "assistant", call(("p", "add", {"x": 1, "y": 1}, ["r"]), ("r", "add", {"x": 1, "y": 1}, ["p"]))), (3, 0, "user", None), (None, 0, "user", "x"), (1, 1, "user", "hi {"),
        (4, 0, "assistant", call(*((f"k{i}", "add", {"x": i, "y": 0}, [f"k{i - 1}"] if i else None) for i in range(40)), ("m", "add", {"x": 0, "y": 0}, ["k3", "k39"]), ("n", "add", {"x": 0, "y": 0}, ["m"]))),
    ]
    schemas = spark.createDataFrame([("add", "x", "BIGINT", True), ("add", "y", "BIGINT", True)], chat.PARAMETERS)
    m = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = chat.formatted(m, schemas).collect()
    by = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r for r in got}
    a, b, c = (by[(1, "call", x, 2)] for x in "abc")
    assert a["linked"] and a["level"] == 0 and a["faults"] == [] and a["json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","role":"assistant","type":"tool_call"}'
    assert b["level"] == 1 and b["faults"] == ["missing y", "type x"] and not b["linked"]
    assert c["level"] is None and not c["resolved"] and c["faults"] == ["unknown tool"]
    assert by[(1, "result", "a", 3)]["linked"] and not by[(1, "result", "a", 4)]["linked"] and by[(1, "result", "a", 3)]["place"] == 2
    assert by[(1, "result", "a", 3)]["json"] == '{"content":{"b":[1],"z":1},"id":"a","role":"tool","type":"tool_result"}'
    assert by[(2, "call", "p", 0)]["level"] is None and by[(2, "call", "r", 0)]["level"] is None
    assert by[(4, "call", "k39", 0)]["level"] == 39 and by[(4, "call", "m", 0)]["level"] == 40 and by[(4, "call", "n", 0)]["level"] == 41
    assert by[(3, "message", None, 0)]["json"] == '{"role":"user","type":"message"}'
    assert sum(r["kind"] == "message" and r["turn"] == 1 for r in got) == 2
    order = [(r["kind"], r["call_id"]) for r in chat.formatted(m.where("conv_id = 1"), schemas).orderBy(*chat.sort_keys()).collect()]
    assert order.index(("call", "a")) < order.index(("result", "a")) < order.index(("call", "b"))
    assert chat.formatted(m.where("false"), schemas).count() == 0


def test_sharding(spark, docs, nothing):
    out = sharding.kd_shards(docs, 5).collect()
    given = pairs_of(docs)
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == multiset((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in given)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(5))
    rng = random.Random(1)
    many = spark.createDataFrame([(i, "x" * rng.randrange(0, 300) if i % 3 else "same text") for i in range(3000)], "doc_id long, text string").repartition(3)
    sizes, group = collections.Counter(), collections.Counter()
    for r in sharding.kd_shards(many, 24).collect():
        sizes[r["shard"]] += r["size"]
        group[r["size"]] += r["size"]
    # groups of equal texts of at most an even shard aren't parted
    whole = max(g for g in group.values() if g <= sum(sizes.values()) / 24)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * max(308, whole)
    assert sharding.kd_shards(nothing).count() == 0


def test_pieces_follow_the_library(docs, nothing):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.Vocabulary()
    rng = random.Random(6)
    odd = ["", " ", "  a  b", "\n\t", "▁x▁", "日本語 텍스트", "𝔘́é", "<s></s>", "<0x41>", " " * 50, "z" * 200, "\x00\x7f", "e\r\nf"]
    odd += ["".join(rng.choice("ab theing  \n▁éÜ1.,日​") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    odd += [t for _, t in pairs_of(docs) if t]
    ids, n = pieces.Encoder(v).encode(odd)
    at = 0
    for t, k in zip(odd, n):
        assert ids[at : at + k].tolist() == lib.encode(t), t
        at += k
    assert [b.decode() for b in pieces.decode(ids, n, v)] == [lib.decode(lib.encode(t)) for t in odd]
    got = pieces.tokenised(docs, tokens=True).collect()
    assert len(got) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert pieces.tokenised(nothing).count() == 0


def test_pieces_of_long_unbroken_texts():
    from sentencepiece import SentencePieceProcessor

    lib, v = SentencePieceProcessor(model_file=pieces.MODEL), pieces.Vocabulary()
    rng = random.Random(2)
    texts = ["".join(rng.choice(a) for _ in range(n)) for n, a in ((201, "ab"), (200, "ab"), (3000, "aaab"), (5000, "theing"), (4000, "日本é語"), (2500, "aA0+/=-"), (1200, " z"))]
    ids, n = pieces.Encoder(v).encode(texts)
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [lib.encode(t) for t in texts]
    big = "".join(rng.choice("ABCDEFGHIJabcdefghij0123456789+/") for _ in range(1_000_000))
    began = time.time()
    ids, _ = pieces.Encoder(v).encode([big])
    assert time.time() - began < 15 and ids.tolist() == lib.encode(big)


def test_pieces_refuse_other_models(monkeypatch):
    import sentencepiece

    class Unigram(sentencepiece.SentencePieceProcessor):
        def get_score(self, i):
            return -1.5 - i

    class Folding(sentencepiece.SentencePieceProcessor):
        def encode(self, t):
            return super().encode(t.replace("\ufb01", "fi"))

    for kind, why in ((Unigram, "byte-pair"), (Folding, "changes texts")):
        monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", kind)
        with pytest.raises(ValueError, match=why):
            pieces.Vocabulary()


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://b/", "same"), (9, "http://c/", "same"), (5, None, "same"), (3, "http://d/\r\nX: y", None), (4, "http://e/", ""), (6, "http://f/", "long " * 50000), (None, "http://g/", "odd"), (9, "http://c/", "same"), (9, "http://a", "same")]
    out = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha string, payload string").repartition(2)
    path = warc.archived(out)
    read = spark.read.format("warc").option("path", path)
    every = read.load().collect()
    got = {(r["record_id"], r["record_type"]): r for r in every}
    one = lambda i, kind="response": got[(f"<urn:page:{i}>", kind)]
    assert len(every) == len(rows) and sum(r["record_type"] == "response" for r in every) == 5
    assert one(9)["target_uri"] == "http://c/" and sum(r["record_id"] == "<urn:page:9>" for r in every) == 3
    assert one(2, "revisit")["refers_to"] == one(9, "revisit")["refers_to"] == "<urn:page:9>" and one(2, "revisit")["payload"] == b""
    assert one(6)["payload"].decode() == "long " * 50000 and one(1)["payload"].decode() == "<p>é</p>"
    assert one(3, "revisit")["refers_to"] == "<urn:page:4>" and one(4)["payload_bytes"] == 0
    assert one(1)["payload_digest"] == warc.digest("<p>é</p>".encode()) and re.fullmatch(r"\d{4}(-\d\d){2}T\d\d(:\d\d){2}Z", one(1)["date"])
    assert one(5, "revisit")["target_uri"] is None and one(3, "revisit")["target_uri"] == "http://d/ X: y"
    for span in (100, 1000, 5000):
        assert read.option("span", span).load().count() == len(rows)
    assert read.load().where("record_type = 'revisit'").count() == 5 and read.load().where("payload_bytes > 9").count() == 1 and read.load().where("refers_to is null").count() == 5
    assert read.option("payload", "false").load().where("payload is not null").count() == 0
    assert read.option("uri_prefix", "http://a").load().count() == 2
    pushed = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(pushed.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    assert spark.read.format("warc").option("path", warc.archived(out.where("false"))).load().count() == 0
    back = spark.read.format("warc").option("path", path).load().where("record_type = 'response'")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        back.write.format("warc").mode(mode).option("path", f"{path}/../copy").save()
        assert spark.read.format("warc").option("path", f"{path}/../copy").load().count() == 5 * times


def test_warc_skips_and_refuses():
    rng = random.Random(1)
    row = lambda i, body, kind="response": {"record_type": kind, "target_uri": f"http://{i}", "payload": body, "payload_bytes": len(body), "record_id": str(i)}
    bodies = [bytes(rng.choices(range(256), k=3_000_000)), b"a" * 5_000_000, b"small", b"", b"\r\n\r\nWARC/1.1\r\n\r\n\x1f\x8b\x08" * 9]
    own = b"".join(warc.member(warc.record(row(i, b))) for i, b in enumerate(bodies))
    assert gzip.decompress(own) == b"".join(warc.record(row(i, b)) for i, b in enumerate(bodies))
    some = lambda r: r["target_uri"] == "http://2"

    def run(data, wanted=lambda r: True, payload=True):
        source = warc.Source(io.BytesIO(data))
        return list(warc.records(None, 0, len(data), wanted, payload, source)), source.inflated

    def foreign(b, name=""):
        out = io.BytesIO()
        with gzip.GzipFile(name, "wb", fileobj=out) as f:
            f.write(b)
        return out.getvalue()

    found, inflated = run(own)
    assert [r["payload"] for r in found] == bodies and inflated > 8_000_000
    found, inflated = run(own, some)
    assert [r["payload"] for r in found] == [b"small"] and inflated < 5 * warc.STEP
    found, inflated = run(own, payload=False)
    assert [r["payload_bytes"] for r in found] == list(map(len, bodies)) and inflated < 6 * warc.STEP
    named = b"".join(foreign(warc.record(row(i, b)), "a.warc") for i, b in enumerate(bodies))
    assert [r["payload"] for r in run(named)[0]] == bodies and len(run(named, some)[0]) == 1
    for bad in (own[: len(own) // 2], named[:-30], own + b"junk", foreign(warc.record(row(1, b"x")) * 2), foreign(b"no record")[:20] + own[10:]):
        with pytest.raises((ValueError, zlib.error)):
            assert len(run(bad)[0]) == 5, "rows were left out"
            raise ValueError
    flat = b"".join(warc.record(row(i, b)) for i, b in enumerate(bodies))
    assert [r["payload"] for r in warc.plain_records(io.BytesIO(flat), lambda r: True, True)] == bodies
    assert [r["payload"] for r in warc.plain_records(io.BytesIO(flat), some, True)] == [b"small"]
    with pytest.raises(ValueError, match="truncated"):
        list(warc.plain_records(io.BytesIO(flat[:-10]), lambda r: True, True))
    assert b"WARC-Profile" in warc.record(row(1, b"", "revisit")) and b"WARC-Profile" not in warc.record(row(1, b""))


def test_pipeline(spark, docs, nothing, tmp_path):
    """Each stage against its brute force on the rows that the one before kept; the first against its predictions."""
    import corpus_pipeline
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=pieces.MODEL)
    items = [(1, " ".join(words1(pairs_of(docs)[0][1]))), (2, "a b c d")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "sentencepiece"]
    kept = {"": docs}
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, last, str(tmp_path)).write.parquet(str(tmp_path / name))
        last = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "sentencepiece" or last.columns == docs.columns
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    texts = {name: pairs_of(df) for name, df in kept.items() if name != "sentencepiece"}
    assert multiset(texts["language_id"]) == multiset((d, t) for d, t in texts[""] if t and re.search(r"[^\W\d_]", t))
    given = texts["language_id"]
    heads = {c for d, n, c in components(given) if c is not None}
    assert multiset((d,) for d, _ in texts["near_duplicates"]) == multiset([(h,) for h in heads] + [(d,) for d, n, c in components(given) if c is None])
    assert set(texts["near_duplicates"]) <= set(given)
    want = [(d, k if g else t) for (d, t), (_, _, g, k) in zip(texts["near_duplicates"], removals(texts["near_duplicates"]))]
    assert multiset(texts["substring_dedup"]) == multiset(want)
    want = [r for r, x in zip(texts["substring_dedup"], contamination(texts["substring_dedup"], items)) if not x[5]]
    assert multiset(texts["decontamination"]) == multiset(want) and 0 < len(want) < len(texts["substring_dedup"])
    assert multiset((r["doc_id"], tuple(r["ids"])) for r in last.collect()) == multiset((d, tuple(lib.encode(t))) for d, t in want)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)

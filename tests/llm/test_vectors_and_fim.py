"""Hard negatives, near vectors and fill-in-the-middle against loops over all pairs and code points."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipspark.llm import fim, hard_negatives, near_vectors

ROWS = "vec_id long, label int, vector array<double>, rank int, key string"


def vectors():
    """Groups of near-copies and copies, ties, nulls, bad components, short and long vectors, ids that repeat."""
    rng = np.random.default_rng(3)
    out = [(i, int(rng.integers(4)), rng.standard_normal(12).tolist()) for i in range(260)]
    base = rng.standard_normal(12)
    out += [(300 + i, 1, (base + rng.standard_normal(12) * 0.03).tolist()) for i in range(90)]
    out += [(400 + i, 2, base.tolist()) for i in range(40)]
    out += [out[5], out[5], (7, 3, rng.standard_normal(12).tolist()), (500, 1, [0.0] * 12), (501, 1, []), (502, 1, None), (503, None, base.tolist()), (None, 1, base.tolist())]
    out += [(504, 1, [1.0, None] + [0.0] * 10), (505, 1, [math.nan] + [1.0] * 11), (506, 1, [math.inf] + [1.0] * 11), (507, 1, [3.0, 1.0]), (508, 1, [6.0, 2.0]), (600, 0, [2.0] * 12), (700, 0, [-2.0] * 12)]
    return [(i, l, v, 0, "clash") for i, l, v in out]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    spark.createDataFrame(vectors(), ROWS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def good(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def padded(v):
    return v + [0.0] * (12 - len(v))


def negatives_by_loops():
    own = [(i, l, [math.floor(256 * c) for c in padded(v)]) for i, l, v, *_ in vectors() if i is not None and l is not None and good(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for anchor in sorted({i for i, *_ in own if i % 100 == 0}):
        _, label, v = min((x for x in own if x[0] == anchor), key=lambda x: x[1:])
        best = lambda xs: sorted(set(xs), key=lambda x: (-x[0], x[1]))[:5]
        others = [(dot(v, w), i, l) for i, l, w in own if i != anchor]
        for p, positive in best((s, i) for s, i, l in others if l == label):
            for rank, (s, i) in enumerate(best((s, i) for s, i, l in others if l != label and 80 * p <= 100 * s <= 100 * p), 1):
                out.add((anchor, positive, rank, i, p, s))
    return out


@pytest.mark.parametrize("sizes", [{}, {"anchors": 1, "vectors": 50, "groups": 3}])
def test_hard_negatives(rows, sizes):
    got = [tuple(r) for r in hard_negatives.hard_negatives(rows, **sizes).collect()]
    assert len(got) == len(set(got))
    assert set(got) == negatives_by_loops()


def test_hard_negatives_of_large_numbers(spark):
    given = spark.createDataFrame([(0, 1, [1e9, 2.0]), (1, 1, [1e5, 0.0]), (2, 2, [9e4, 3.0]), (3, 2, [-1.0, 1e300])], "vec_id long, label int, vector array<double>")
    got = hard_negatives.hard_negatives(given).collect()
    most = 1 << 26
    p = most * (256 * 10**5)
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, p, most * (256 * 9 * 10**4) + 512 * 768)]


def test_no_rows(spark, rows):
    nothing = rows.where("false")
    assert not hard_negatives.hard_negatives(nothing).count()
    assert not hard_negatives.hard_negatives(rows.where("vec_id % 100 <> 0")).count()
    assert not near_vectors.near_vectors(nothing).count()
    assert not fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count()


def links_by_loops():
    """(vec_id, n_links, component_id, kept) of each row."""
    data = [(i, l, np.array(padded(v)) if good(v) and any(v) and i is not None and l is not None else None) for i, l, v, *_ in vectors()]
    near = lambda a, b: a[2] is not None and b[2] is not None and a[1] == b[1] and a[2] @ b[2] / math.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= 0.98
    links = [[j for j, b in enumerate(data) if i != j and near(a, b)] for i, a in enumerate(data)]
    out = []
    for i, a in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = a[0] if a[2] is None else min(data[j][0] for j in seen)
        out.append((a[0], len(links[i]), least, a[2] is None or a[0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"block": 16, "pivots": 16}])
def test_near_vectors(rows, settings):
    # so few dimensions and pivots share enough for all pairs to be candidates that are links
    got = [tuple(r) for r in near_vectors.near_vectors(rows, shared=1, **settings).collect()]
    assert sorted(got, key=str) == links_by_loops()


def test_index_finds_nine_in_ten(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((400, 5, 64)) * rng.uniform(0.005, 0.024, (400, 5, 1))
    data = [(100 * i + k, 1, [float(c) for c in b + n]) for i, b in enumerate(base) for k, n in enumerate([np.zeros(64), *noise[i]])]
    rows = spark.createDataFrame(data, "vec_id long, label int, vector array<double>").repartition(4)
    found = near_vectors.near_vectors(rows).cache()
    assert near_vectors.recall(found, rows) >= 0.9
    assert found.agg(F.sum("n_links")).first()[0] > 1500
    kept = near_vectors.one_of_each(rows).count()
    assert 400 <= kept == found.where("kept").count() < 600


def test_pivots_are_apart():
    rng = np.random.default_rng(1)
    one = rng.standard_normal(8)
    sample = one + rng.standard_normal((50, 8)) * 0.01
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    pivots = near_vectors.pivots_of(sample, 20, 8)
    assert pivots.shape == (20, 8) and (pivots @ sample[0] > 0.99).sum() == 1


def texts():
    rng = random.Random(4)
    letters = ["a", "<", "P", ">", "é", "語", "😀", " ", "\n", "S", "M"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(120)]
    out += ["".join(rng.choice("aé語😀 <") for _ in range(n)) for n in (300, 5000, 5001, 20_000)] * 3
    return out + ["", None, "<P>", "a<S>", "<<M>>", "<P", "x" * 9000 + "<P>" + "y" * 9000, "é" * 4096, "語" * 4097, "😀" * 3000, "x" * 4095 + "<M>"]


def by_code_points(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, t, t)
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, len(t), form, lo, hi - lo, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", t)


@pytest.mark.parametrize("piece", [fim.PIECE, 10_000, 7])
def test_fill_in_middle(spark, piece):
    data = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, "abc déf" * 5, None, None), (3, texts()[3], "x", "y"), (121, texts()[121], "x", "y")]
    if piece == 7:
        data = [d for d in data if not d[1] or len(d[1]) < 400]
    docs = spark.createDataFrame(data, "doc_id long, text string, form string, output string").repartition(3)
    done = fim.fill_in_middle(docs, piece=piece)
    got = done.select("rest.doc_id", "n", done["form"], "prefix_chars", "middle_chars", done["output"], fim.restored(done["output"], done["form"]).alias("t"), F.col("rest.form").alias("own")).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted((by_code_points(d, t) for d, t, *_ in data), key=str)
    assert {r.own for r in got} == {"x", None}


def test_summaries_compose():
    """A summary of two parts is the composition of theirs, wherever the cut."""
    raw = "a<P>é語😀<S<M>x<".encode()
    whole = [x[0] for x in fim.scanned([raw])]
    for cut in range(1, len(raw)):
        parts = [tuple(x[i] for x in fim.scanned([raw[:cut], raw[cut:]])) for i in (0, 1)]
        for x, y in zip(fim.composed(*parts), whole):
            assert (np.asarray(x) == y).all()
    assert fim.scanned([raw])[1][0][0] == len(raw.decode()) and fim.scanned([raw])[2][0][0] == 2

"""Tool calls against a plain topological check; shards against a plain k-d tree; archive batches by bytes."""

import collections
import json
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from snipspark.llm import chat, sharding, warc


def messages():
    """Calls that depend on earlier, later and several calls of other turns, on each other in a circle over three turns, and on none."""
    rng = random.Random(7)
    out = []
    for conv in range(12):
        ids = [f"c{i}" for i in range(18)]
        order = ids[:]
        rng.shuffle(order)  # what may depend on what, whatever the turns
        calls = [(i, [order[j] for j in rng.sample(range(order.index(i)), min(order.index(i), rng.choice([0, 0, 1, 1, 2, 3])))]) for i in ids]
        if conv % 3 == 0:
            calls += [("x", ["y"]), ("y", ["z"]), ("z", ["x"]), ("on-circle", ["x", "c1"]), ("lost", ["nowhere"])]
        for turn in range(0, 3 * len(calls) // 2, 3):
            here, calls = calls[:2], calls[2:]
            out.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "t", "arguments": {}, "depends_on": d} for i, d in here]})))
            for n, (i, _) in enumerate(here):
                out.append((conv, turn + 1 + n, "tool", json.dumps({"tool_call_id": i, "content": "x" * (100_000 if conv == 1 and turn == 0 else 1)})))
    return out + [(20, 0, "user", "alone"), (None, 0, "user", "of none"), (None, 1, "user", "of none too")]


def test_calls_are_in_topological_order(spark):
    rows = spark.createDataFrame(messages(), "conv_id long, turn long, role string, text string").repartition(4)
    schemas = spark.createDataFrame([], chat.PARAMETERS)
    got = chat.positioned(chat.formatted(rows, schemas)).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.position)):
        by[r.conv_id].append(r)
    assert all([r.position for r in rs] == list(range(len(rs))) for rs in by.values())
    forward = 0
    for conv, turn, _, text in messages():
        for call in json.loads(text).get("tool_calls", []) if text.startswith("{") else []:
            at = {(r.kind, r.call_id): r for r in by[conv]}
            mine = at["call", call["id"]]
            assert at["result", call["id"]].position > mine.position
            if mine.resolved:
                for d in call["depends_on"]:
                    assert at["call", d].position < mine.position and at["result", d].position < mine.position
                    forward += at["call", d].turn > turn
            else:
                assert call["id"] in ("x", "y", "z", "on-circle", "lost")
    assert forward > 20
    assert all(not r.resolved for c in (0, 3) for r in by[c] if r.call_id in ("x", "lost"))


def tree_by_loops(rows, shards):
    """Shard of each row (doc_id, text): recursive weighted medians along the widest dimension, groups of equal texts whole up to an even shard."""
    facts = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
        facts.append({"size": len(raw) + 8, "crc": __import__("zlib").crc32(raw), "chars": len(text or ""), "digest": xxhash.xxh64_intdigest(raw, 42), "uid": xxhash.xxh64_intdigest(raw, seed)})
    for f in facts:
        f["keys"] = []
    for d in ("size", "crc", "chars"):
        lo, hi = min(f[d] for f in facts), max(f[d] for f in facts)
        for f in facts:
            f["keys"].append((int((f[d] - lo) / max(hi - lo, 1) * (sharding.TOP - 1)) << 32) | (f["digest"] % (1 << 16) << 16) | f["uid"] % (1 << 16))
    leaf, out = sum(f["size"] for f in facts) / shards, [0] * len(facts)
    total = collections.Counter()
    for f in facts:
        total[f["digest"]] += f["size"]

    def cut(bins, goal, left):
        """(number of bins on the left, bin that holds the goal, bytes before it)."""
        for n, (key, size) in enumerate(bins):
            if left + size >= goal or n + 1 == len(bins):
                return key, size, left
            left += size

    def split(members, first, k):
        for i in members:
            out[i] = first
        if k == 1 or not members:
            return
        span = [max(facts[i]["keys"][d] for i in members) - min(facts[i]["keys"][d] for i in members) for d in range(3)]
        d = span.index(max(span))
        goal = k // 2 / k * sum(facts[i]["size"] for i in members)
        groups, single = collections.Counter(), collections.Counter()
        for i in members:
            groups[facts[i]["keys"][d] >> 16] += facts[i]["size"]
        key, size, left = cut(sorted(groups.items()), goal, 0)
        shift = 16
        if any(total[facts[i]["digest"]] > leaf for i in members if facts[i]["keys"][d] >> 16 == key):
            for i in members:
                if facts[i]["keys"][d] >> 16 == key:
                    single[facts[i]["keys"][d]] += facts[i]["size"]
            key, size, left = cut(sorted(single.items()), goal, left)
            shift = 0
        last = ((key + 1 if left + size - goal <= goal - left else key) << shift) - 1
        split([i for i in members if facts[i]["keys"][d] <= last], first, k // 2)
        split([i for i in members if facts[i]["keys"][d] > last], first + k // 2, k - k // 2)

    split(list(range(len(facts))), 0, shards)
    return out


def many():
    rng = random.Random(3)
    rows = [(i, f"text {i % 290} of ten" + "!" * (i % 290 % 23)) for i in range(2900)]
    return rows + [(5000 + i, "copied " * 9) for i in range(900)] + [(None, None), (None, "x"), (7, "y" * 3000), (8, ""), (8, "")] + [(9000 + i, "é" * rng.randrange(200)) for i in range(100)]


@pytest.mark.parametrize("shards", [24, 5])
def test_shards_are_those_of_a_plain_tree(spark, shards):
    rows = many()
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards)
    key = lambda rs: collections.Counter(rs)
    want = tree_by_loops(rows, shards)
    sizes = [len((t or "").encode()) + 8 for _, t in rows]
    assert key((r.doc_id, r.size, r.shard) for r in got.collect()) == key((d, s, w) for (d, _), s, w in zip(rows, sizes, want))
    total, of = sum(sizes), collections.defaultdict(set)
    bytes_of, per = collections.Counter(), collections.Counter()
    for (_, t), s, w in zip(rows, sizes, want):
        of[t or ""].add(w)
        bytes_of[t or ""] += s
        per[w] += s
    assert all(len(of[t]) == 1 for t, b in bytes_of.items() if b <= total / shards) and len(of["copied " * 9]) > 1
    assert max(per.values()) - min(per.values()) < 0.2 * total / shards


def test_shards_and_slots_dont_follow_the_split(spark):
    rows = many()[:1500]
    one, other = (sorted(map(str, sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), 7).collect())) for n in (2, 7))
    assert one == other


def test_batches_of_large_payloads(tmp_path, monkeypatch):
    """A reader holds at most about HELD bytes, however many rows of whatever size a span has."""
    monkeypatch.setattr(warc, "HELD", 10_000)
    rows = [{"payload": b"x" * 3000}] * 40
    monkeypatch.setattr(warc, "records", lambda *a: iter([{f.name: None for f in warc.ARROW} | r for r in rows]))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"x")
    reader = warc.WarcReader.__new__(warc.WarcReader)
    reader.path, reader.tests, reader.payload = str(tmp_path), [], True
    sizes = [b.num_rows for b in reader.read(warc.Span(str(path), 0, 1))]
    assert sum(sizes) == 40 and max(sizes) == 4


def test_op6_runs_few_jobs(spark, tmp_path):
    """The driver's memory goes with the jobs and plans that it holds: one of some sixty jobs took more than 1,500 MB."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}") for c in range(40) for t in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.sparkContext.setJobGroup("op6", "op6")
    got = chat.op6(spark, str(tmp_path)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("op6"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(got) == len(rows) and 5 < jobs <= 32, jobs


def test_levels_and_faults_of_odd_calls(spark):
    """Long chains, chains that end at a missing call, in a circle, at a call of several needs, ids that repeat, null ids, turns and conversations."""
    rng = random.Random(3)
    rows = []

    def call(conv, turn, *calls):
        rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "t", "arguments": a, "depends_on": d} for i, d, a in calls]})))

    graph = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(70)}
    graph |= {f"l{i}": [f"l{i - 1}"] if i else ["nowhere"] for i in range(9)}
    graph |= {f"r{i}": [f"r{(i - 1) % 5}"] for i in range(5)} | {f"t{i}": [f"t{i - 1}"] if i else ["r2"] for i in range(6)}
    graph |= {"s": ["c3", "c68"], "s2": ["s", "c1", "s"], "gone": ["s", "nowhere"]} | {f"e{i}": [f"e{i - 1}"] if i else ["s2"] for i in range(7)}
    graph |= {f"hub{i}": ["c0"] for i in range(30)}
    turns = {k: rng.randrange(50) for k in graph}
    for conv in (1, 2):
        for k, d in rng.sample(sorted(graph.items()), len(graph)):
            call(conv, turns[k], (k, d, {}))
            rows.append((conv, turns[k] + 1, "tool", json.dumps({"tool_call_id": k, "content": 1})))
    call(3, 5, ("a", [], {"x": 1, "y": None, "z": [1]}), ("a", ["a"], {"x": "1"}), (None, [], [1]), ("b", [None], {"w": 1.5}))
    call(3, 4, ("a", [], {"x": True}))
    call(None, 1, ("a", [], {}), ("b", ["a"], {}))
    rows += [(None, 2, "tool", json.dumps({"tool_call_id": "a"})), (3, 9, "tool", json.dumps({"tool_call_id": "b"})), (3, 8, "assistant", json.dumps({"tool_calls": []})), (3, None, "user", "late")]
    schemas = spark.createDataFrame([("t", "x", "BIGINT", True), ("t", "y", "STRING", False), ("t", "z", "ARRAY", False), ("t", "z", "OBJECT", False), ("t", "w", None, None)], chat.PARAMETERS)
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), schemas).collect()

    def settled(k, path=()):
        """Level and place of a call, or None."""
        if k not in graph or k in path:
            return None
        below = [settled(d, (*path, k)) for d in graph[k]]
        return None if None in below else (1 + max((x[0] for x in below), default=-1), max([turns[k], *(x[1] for x in below)]))

    at = {(r.conv_id, r.kind, r.call_id): r for r in got if r.conv_id in (1, 2)}
    assert len(at) == 4 * len(graph)
    for conv, kind, k in at:
        r, want = at[conv, kind, k], settled(k)
        assert (r.level, r.place) == (want or (None, turns[k])) and r.resolved == bool(want) and r.linked and r.faults == (["missing x"] if kind == "call" else []), k
    odd = sorted(([r.conv_id, r.turn, r.kind, r.item, r.call_id, r.level, r.place, r.linked, r.faults] for r in got if r.conv_id not in (1, 2)), key=str)
    assert odd == sorted([
        [3, 5, "call", 0, "a", 0, 5, False, ["type y", "type z"]], [3, 5, "call", 1, "a", 1, 5, False, ["type x"]], [3, 5, "call", 2, None, 0, 5, False, ["missing x"]], [3, 5, "call", 3, "b", None, 5, True, ["missing x", "unknown w"]],
        [3, 4, "call", 0, "a", 0, 4, False, ["type x"]], [3, 9, "result", 0, "b", None, 5, True, []], [3, None, "message", 0, None, 0, None, False, []],
        [None, 1, "call", 0, "a", 0, 1, False, ["missing x"]], [None, 1, "call", 1, "b", None, 1, False, ["missing x"]], [None, 2, "result", 0, "a", None, 2, False, []],
    ], key=str)

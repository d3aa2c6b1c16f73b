"""The dependency graph: building it from symbols, imports and references, neighbours by bounded breadth-first search, popularity."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .names import holding, name_postings
from .search import small

#: Extensions that an import's path is tried with, in this order, also with index files.
TRIED = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp"]


def file_node(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, kind, name, file_path, symbol_kind): one node for each file and symbol."""
    f = files.select(file_node(F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("symbol_kind"))
    s = symbols.select("id", F.lit("symbol").alias("kind"), "name", "file_path", F.col("kind").alias("symbol_kind"))
    return f.unionByName(s).dropDuplicates(["id"])


def resolved_path(from_file: Column, source: Column) -> Column:
    """The path that a relative import names, without extension: segments applied one by one."""
    start = F.slice(F.split(from_file, "/"), 1, F.size(F.split(from_file, "/")) - 1)
    step = lambda d, p: F.when(p == ".", d).when(p == "..", F.slice(d, F.lit(1), F.greatest(F.size(d) - 1, F.lit(0)))).otherwise(F.concat(d, F.array(p)))
    return F.array_join(F.aggregate(F.split(source, "/"), start, step), "/")


def tried_paths(imports: DataFrame) -> DataFrame:
    """(id, file_path, priority, path): the paths that each relative import may name."""
    base = imports.where(F.col("source").startswith(".")).select("id", "file_path", resolved_path(F.col("file_path"), F.col("source")).alias("base"))
    stem = F.regexp_replace("base", r"\.[A-Za-z]+$", "")
    tried = [F.concat("base", F.lit(e)) for e in TRIED] + [F.concat("base", F.lit(f"/index{e}")) for e in TRIED] + [F.col("base")] + [F.concat(stem, F.lit(e)) for e in TRIED]
    return base.select("id", "file_path", F.posexplode(F.array(*tried)).alias("priority", "path"))


def resolve_imports(imports: DataFrame, files: DataFrame, symbols: DataFrame, by_name: bool = False) -> DataFrame:
    """(id, file_path, target_path): the first existing file of 24 candidates and, so that `./x.js` finds `x.ts`, of the
    path without its own extension. With by_name an unresolved source goes to the file of the first symbol, by name,
    that contains its last segment."""
    hit = tried_paths(imports).join(files.select("path"), "path").groupBy("id", "file_path").agg(F.min_by("path", "priority").alias("target_path"))
    if not by_name:
        return hit
    left = imports.join(hit.select("id"), "id", "left_anti").select("id", "file_path", F.element_at(F.split("source", "/"), -1).alias("last"))
    # the first name of each source alone meets the symbols
    name = holding(left, name_postings(symbols), "last").groupBy(F.col("pattern").alias("last")).agg(F.min("name").alias("name"))
    best = stored(symbols.join(small(stored(name)), "name").groupBy("last").agg(F.min_by("file_path", "id").alias("target_path")))
    return hit.unionByName(left.join(small(best), "last").select("id", "file_path", "target_path"))


def resolve_names(refs: DataFrame, symbols: DataFrame, legacy: bool = False) -> DataFrame:
    """(ref_id, symbol_id) for references (ref_id, file_path, name): a symbol of that name in the same file, else the
    first of that name anywhere. With legacy a same-file symbol need only contain the name."""
    last = refs.withColumn("short", last_part(F.col("name")))
    word = "name" if legacy else "short"
    # symbols that share name and file are one row before they meet references, references that share both are answered once
    own = symbols.groupBy("file_path", F.col("name").alias("sname")).agg(F.min("id").alias("symbol_id"))
    if legacy:
        asked = stored(last.select("file_path", "name").where("file_path is not null and name is not null").distinct())
        found = holding(asked, name_postings(own, "sname", ("file_path",)), "name", ("file_path",)).select("file_path", F.col("pattern").alias("name"), F.col("name").alias("sname"))
        pairs = found.join(own, ["file_path", "sname"]).unionByName(asked.where("name = ''").join(own, "file_path"))
        local = pairs.groupBy("file_path", "name").agg(F.min_by("symbol_id", F.struct("sname", "symbol_id")).alias("near"))
    else:
        local = own.select("file_path", F.col("sname").alias(word), F.col("symbol_id").alias("near"))
    first = own.groupBy(F.col("sname").alias(word)).agg(F.min("symbol_id").alias("far"))
    return last.join(local, ["file_path", word], "left").join(first, word, "left").select("ref_id", F.coalesce("near", "far").alias("symbol_id")).where("symbol_id is not null")


def last_part(name: Column) -> Column:
    """What a dotted name names."""
    return F.element_at(F.split(name, r"\."), -1)


def affected(touched: DataFrame, names: DataFrame, imports: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_path) of the files whose links and edges may differ after files were touched: those files, files that may import one of them,
    and files with a reference to a name that is a symbol there, before or after."""
    importing = tried_paths(imports).join(touched.withColumnRenamed("file_path", "path"), "path", "left_semi").select("file_path")
    naming = refs.withColumn("name", last_part(F.col("to_name"))).join(names, "name", "left_semi").select("file_path")
    return touched.unionByName(importing).unionByName(naming).distinct()


def edges(files: DataFrame, symbols: DataFrame, imports: DataFrame, refs: DataFrame, legacy: bool = False, of: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, kind, file_path) of the whole graph at once, so that it doesn't depend on any order of files; file_path is the
    file that an edge comes from. With `of` (file_path) the edges of these files alone; imports and refs are theirs then."""
    own = symbols if of is None else symbols.join(of, "file_path", "left_semi")
    contains = own.select(file_node(F.col("file_path")).alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("kind"), "file_path")
    targets = resolve_imports(imports, files, symbols, legacy)
    to_files = targets.select(file_node(F.col("file_path")).alias("from_id"), file_node(F.col("target_path")).alias("to_id"), F.lit("imports").alias("kind"), "file_path")
    wanted = imports.select("id", F.explode("imported_names").alias("wanted")).join(targets, "id")
    to_symbols = wanted.join(symbols.select(F.col("id").alias("to_id"), "name", F.col("file_path").alias("target_path")), "target_path").where(F.expr("contains(name, wanted)") if legacy else F.col("name") == F.col("wanted"))
    to_symbols = to_symbols.groupBy("file_path", "id", "wanted").agg(F.min_by("to_id", F.struct((F.col("name") != F.col("wanted")).alias("inexact"), "name", "to_id")).alias("to_id")).select(file_node(F.col("file_path")).alias("from_id"), "to_id", F.lit("imports").alias("kind"), "file_path")
    uses = resolve_names(refs.select(F.col("id").alias("ref_id"), "file_path", F.col("to_name").alias("name")), symbols, legacy).join(refs.select(F.col("id").alias("ref_id"), "from_symbol_id", "kind", "file_path"), "ref_id")
    uses = uses.where("symbol_id <> from_symbol_id").select(F.col("from_symbol_id").alias("from_id"), F.col("symbol_id").alias("to_id"), F.when(F.col("kind") == "call", "calls").otherwise("references").alias("kind"), "file_path")
    return contains.unionByName(to_files).unionByName(to_symbols).unionByName(uses)


def adjacent(edges: DataFrame, kinds: list[str] | None = None, known: DataFrame | None = None, legacy_precedence: bool = False, once: bool = True) -> DataFrame:
    """(a, b): which nodes are next to which, both ways; once each, unless the reader drops repeats itself."""
    allowed = F.col("kind").isin(kinds) if kinds else F.lit(True)
    if legacy_precedence:
        both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(edges.where(allowed).select(F.col("to_id").alias("a"), F.col("from_id").alias("b")))
    else:
        way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        both = edges.where(allowed).select(F.explode_outer(F.array(way("from_id", "to_id"), way("to_id", "from_id"))).alias("x")).select("x.*")
    both = both.distinct() if once else both
    return both if known is None else both.join(known.select(F.col("id").alias("b")), "b", "left_semi")


#: Neighbours of a node beyond which they are dealt over several keys; seeds that one number stands for; seeds from which lists of the nearest are kept for all nodes.
HUB, BITS, MANY = 10_000, 64, 5000
#: Nearest nodes of a neighbour that are looked at before a bound is known, at least; places of lists that a task merges at once.
HEAD, PLACES = 4, 1 << 20


def first_lists(batches):
    """(a, ids): each a and its different b, from rows (a, b) in order."""
    left = None
    for batch in chain(batches, [None]):
        rows = pa.Table.from_batches([x for x in (left, batch) if x is not None]).combine_chunks() if left is not None or batch is not None else None
        if rows is None or not rows.num_rows:
            continue
        a, b = (rows.column(c).chunk(0) for c in ("a", "b"))
        other = lambda c: np.concatenate([[True], pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)])
        new = other(a)
        kept = np.flatnonzero(new | other(b))
        a, b, new = a.take(pa.array(kept)), b.take(pa.array(kept)), new[kept]
        starts = np.flatnonzero(new)
        if batch is not None:  # the last one may go on in the next batch
            left = pa.RecordBatch.from_arrays([a.slice(starts[-1]), b.slice(starts[-1])], ["a", "b"])
            a, b, starts, new = a.slice(0, starts[-1]), b.slice(0, starts[-1]), starts[:-1], new[: starts[-1]]
        names = a.take(pa.array(starts))
        # each name before its own
        ends = np.append(starts, len(a))
        order = np.insert(np.arange(len(a)) + len(names), starts, np.arange(len(names)))
        ids = pa.concat_arrays([names, b]).take(pa.array(order))
        yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), ids)], ["a", "ids"])


def merged(table: pa.Table, most: int, depth: int) -> pa.Table:
    """(a, head, ids, far, bs) of each a in rows (a, b, head, more, ids, far): the `most` nearest nodes of its own list (b null) and of its neighbours' (b), a step
    further, and the neighbours of whose lists the rest (`more`) may hold nearer ones."""
    table = table.combine_chunks()
    col = lambda n: table.column(n).chunk(0)
    a, ids = col("a").dictionary_encode(), col("ids")
    names, row = a.dictionary, a.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(ids).to_numpy())
    flat = ids.flatten().dictionary_encode()
    place = pc.sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    total, steps, theirs = len(place), depth + 1, col("b").is_valid().to_numpy(zero_copy_only=False)
    node, owner = rank[flat.indices.to_numpy()], np.repeat(row.astype(np.int64), np.diff(ends, prepend=0))
    far = col("far").flatten().to_numpy().astype(np.int64) + np.repeat(theirs, np.diff(ends, prepend=0))
    by = np.sort((owner * total + node) * steps + far)  # of each node the least distance, then the nearest of each a
    by = by[np.concatenate([[True], by[1:] // steps != by[:-1] // steps])]
    by = np.sort((by // steps // total * steps + by % steps) * total + by // steps % total)
    first = np.searchsorted(by, np.arange(len(names) + 1) * steps * total)
    by = by[np.arange(len(by)) - np.repeat(first[:-1], np.diff(first)) < most]
    first = np.searchsorted(by, np.arange(len(names) + 1) * steps * total)
    # beyond the last of a full list nothing counts
    bound = np.where(np.diff(first) >= most, by[first[1:] - 1], np.iinfo(np.int64).max)
    asked = np.flatnonzero(col("more").to_numpy(zero_copy_only=False))
    asked = asked[(owner[ends[asked] - 1] * steps + far[ends[asked] - 1]) * total + node[ends[asked] - 1] < bound[row[asked]]]
    asked = asked[np.argsort(row[asked], kind="stable")]
    heads = np.zeros(len(names), np.int32)
    heads[row] = col("head").to_numpy()
    listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    found = listed(first, flat.dictionary.take(pa.array(place[by % total])))
    return pa.table({"a": names, "head": pa.array(heads), "ids": found, "far": listed(first, pa.array((by // total % steps).astype(np.int32))), "bs": listed(np.searchsorted(row[asked], np.arange(len(names) + 1)), col("b").take(pa.array(asked)))})


def nearest_lists(adjacent: DataFrame, depth: int, limit: int, seeds: DataFrame | None = None) -> DataFrame:
    """(a, ids, far): for each of the seeds (column a; all nodes without them) that has neighbours the `limit` + 1 nearest nodes within `depth` steps, itself
    included, and how far they are, in order, from a table (a, b) of which nodes are next to which, repeats allowed.

    A node among the nearest of a node is also among the nearest of the neighbour that the way leads over, so a step merges the
    neighbours' lists: first their heads, a few nodes each, which tell how far the last of the nearest can be; then of those lists whose
    head ends before it more, twice as much each time. A node whose list is full of nodes within the steps so far takes no further step, nor does one that no seed's later step can ask for."""
    most, kind = limit + 1, adjacent.schema["a"].dataType.simpleString()
    near = adjacent.where("a <> b").withColumn("n", F.dense_rank().over(Window.partitionBy("a").orderBy("b"))).where(F.col("n") <= limit)
    lists = stored(near.select("a", "b").sortWithinPartitions("a", "b").mapInArrow(first_lists, f"a {kind}, ids array<{kind}>").select("a", "ids", F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.size("ids") - 1)).alias("far"), (F.size("ids") >= most).alias("full")))
    # up to which step a node takes part: seeds up to the last, what a seed with room reaches in a step up to the step before, and so on
    due = (lists if seeds is None else seeds.distinct()).select("a", F.lit(depth).alias("due"))
    for step in range(depth - 1, 1, -1) if seeds is not None else ():
        over = lists.where(~F.col("full")).join(due.where(F.col("due") == step + 1), "a").select(F.explode("ids").alias("a"), F.lit(step).alias("due"))
        due = stored(due.unionByName(over).groupBy("a").agg(F.max("due").alias("due")))
    lists = stored(lists.join(due, "a", "left").withColumn("due", F.coalesce("due", F.lit(1))))
    shape = f"a {kind}, head int, ids array<{kind}>, far array<int>, bs array<{kind}>"
    for step in range(1, depth):
        open_ = (~F.col("full")) & (F.col("due") > step)
        wanting = lists.where(open_)
        count = wanting.count()
        if not count:
            continue
        blocks = -(-count * 4 * most // PLACES)

        def merge(rows, blocks=blocks):
            block = F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("block")
            return stored(rows.groupBy(block).applyInArrow(lambda t: merged(t, most, depth), shape))

        around = F.size(F.filter("far", lambda x: x == 1))
        # enough of each neighbour that together they fill the list about twice
        wanting = wanting.withColumn("head", F.greatest(F.lit(HEAD), F.ceil(2 * (most - F.size("ids")) / around)).cast("int"))
        theirs = lists.select(F.col("a").alias("b"), F.col("ids").alias("x"), F.col("far").alias("y"))
        columns = lambda b, more: ["a", b.alias("b"), "head", more.alias("more"), "ids", "far"]
        own = wanting.select(*columns(F.lit(None).cast(kind), F.lit(False)))
        ways = wanting.select("a", "head", F.explode_outer(F.slice("ids", F.lit(2), around)).alias("b"))
        # the first of a neighbour's list is itself, which is known
        heads = ways.join(theirs, "b").withColumns({"ids": F.slice("x", F.lit(2), F.col("head")), "far": F.slice("y", F.lit(2), F.col("head"))}).select(*columns(F.col("b"), F.size("x") > F.col("head") + 1))
        one = merge(own.unionByName(heads))
        parts = []
        while True:
            parts.append(one.where(F.size("bs") == 0))
            some = one.where(F.size("bs") > 0)
            if some.isEmpty():
                break
            # as much again of the lists that end too early, of which there are fewer each time
            at, twice = F.col("head") + 2, 2 * F.col("head")
            rest = some.select("a", "head", F.explode_outer("bs").alias("b")).join(theirs, "b").withColumns({"ids": F.slice("x", at, F.col("head")), "far": F.slice("y", at, F.col("head")), "more": F.size("x") > twice + 1})
            own = some.select(*columns(F.lit(None).cast(kind), F.lit(False)))
            one = merge(own.unionByName(rest.select(*columns(F.col("b"), F.col("more")))).withColumn("head", twice))
        one = parts[0]
        for part in parts[1:]:
            one = one.unionByName(part)
        # nodes that took this step are due as before
        new = one.select("a", "ids", "far", (F.size("ids") >= most).alias("full")).join(lists.where(open_).select("a", "due"), "a")
        lists = stored(lists.where(~open_).unionByName(new)) if step + 1 < depth else lists.where(~open_).unionByName(new)
    return lists.where(F.col("due") == depth).select("a", "ids", "far")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1, kinds: list[str] | None = None, limit: int = 100, known: DataFrame | None = None, legacy_precedence: bool = False) -> DataFrame:
    """(seed, node_id, distance): undirected breadth-first search from each seed (column seed), least distance first, at
    most `limit` nodes a seed, ties by node. Nodes that `known` (column id) lacks aren't reached. With legacy_precedence
    the kinds restrict incoming edges only.

    Seeds are searched from together: BITS of them are the bits of a number, and a step ors the numbers of all nodes next to a
    node. A seed that has its `limit` of nodes takes no further step, as farther nodes would come after them. The neighbours of a
    hub are dealt over several keys. MANY seeds and more are answered from lists of the nearest of all nodes, as their
    frontiers would grow with seeds times edges."""
    if seeds.select("seed").distinct().count() >= MANY:
        asked = seeds.select(F.col("seed").alias("a")).where("seed is not null").distinct()
        near = nearest_lists(adjacent(edges, kinds, known, legacy_precedence, once=False), depth, limit, asked)
        rest = lambda c, name: F.slice(c, 2, limit).alias(name)  # noqa: E731  (the first is the seed)
        return near.select(F.col("a").alias("seed"), rest("ids", "node_id"), rest("far", "distance")).select("seed", F.inline_outer(F.arrays_zip("node_id", "distance"))).where("node_id is not null")
    both = stored(adjacent(edges, kinds, known, legacy_precedence))
    hubs = stored(both.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"))
    salted = both.join(hubs, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")

    # seeds are dealt to groups of about half as many as there are bits and numbered within these: groups that came out larger take two numbers and more
    given = seeds.select("seed").where("seed is not null").distinct()
    groups = max(1, -(-given.count() // (BITS // 2)))
    place = Window.partitionBy("g").orderBy("seed")
    numbered = given.withColumn("g", F.pmod(F.xxhash64("seed"), F.lit(groups))).withColumn("n", F.row_number().over(place) - 1)
    numbered = stored(numbered.select("seed", F.struct("g", F.floor(F.col("n") / BITS).alias("part")).alias("block"), (F.col("n") % BITS).cast("int").alias("bit")))
    one = lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    frontier = numbered.select("block", F.col("seed").alias("node_id"), one(F.col("bit")).alias("bits"))
    visited, steps = frontier, []
    for step in range(1, depth + 1):
        spread = frontier.join(hubs.withColumnRenamed("a", "node_id"), "node_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        reached = spread.join(salted, (F.col("node_id") == F.col("a")) & (spread["part"] == salted["part"])).groupBy("block", F.col("b").alias("node_id")).agg(F.bit_or("bits").alias("bits"))
        seen = visited.withColumnRenamed("bits", "old")
        new = reached.join(seen, ["block", "node_id"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))).where("bits <> 0").drop("old")
        new = stored(new)
        steps.append(new.withColumn("distance", F.lit(step)))
        if step < depth:
            # a bit for each seed that has enough
            each = lambda rows: rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"), "bits").where(F.expr("bits & shiftleft(1L, bit)") != 0)
            counts = [each(s).groupBy("block", "bit").agg(F.count("*").alias("c")) for s in steps]
            total = counts[0]
            for c in counts[1:]:
                total = total.unionByName(c)
            done = total.groupBy("block", "bit").agg(F.sum("c").alias("c")).where(F.col("c") >= limit).groupBy("block").agg(F.bit_or(one(F.col("bit"))).alias("done"))
            frontier = stored(new.join(done, "block", "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))).where("bits <> 0").drop("done"))
            visited = stored(visited.unionByName(new).groupBy("block", "node_id").agg(F.bit_or("bits").alias("bits")))
    found = steps[0]
    for s in steps[1:]:
        found = found.unionByName(s)
    rows = found.select("block", "node_id", "distance", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")).where(F.expr("bits & shiftleft(1L, bit)") != 0)
    w = Window.partitionBy("seed").orderBy("distance", "node_id")
    return rows.join(numbered, ["block", "bit"]).select("seed", "node_id", "distance").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to_id").alias("node_id")).agg(F.count("*").alias("in_degree"))


def popularity(edges: DataFrame) -> DataFrame:
    return in_degree(edges).withColumn("popularity", F.log1p("in_degree"))


def expand(found: DataFrame, edges: DataFrame, chunks: DataFrame, total_chunks: int, query: str = "query_id") -> DataFrame:
    """(query, chunk_id) that graph expansion adds to found chunks (query, rank, score, symbol_id). Small collections
    (50 chunks and fewer) take 2 seeds, one step and 3 neighbours, and nothing where 3 results are found."""
    little = total_chunks <= 50
    seeds, depth, limit = (2, 1, 3) if little else (5, 2, 10)
    start = found.where((F.col("rank") <= seeds) & F.col("symbol_id").isNotNull() & (F.col("score") >= 0.1))
    if little:
        full = found.groupBy(query).agg(F.count("*").alias("n")).where("n >= 3")
        start = start.join(full, query, "left_anti")
    near = neighbours(edges, start.select(F.col("symbol_id").alias("seed")), depth, ["calls", "imports", "references"], limit)
    first = chunks.where("symbol_id is not null").groupBy("symbol_id").agg(F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("chunk_id"))
    return start.select(query, F.col("symbol_id").alias("seed")).join(near, "seed").join(first, F.col("node_id") == first["symbol_id"]).select(query, "chunk_id").distinct()

"""Text compression as column expressions: line dedupe, block merge, code skeleton, last sentences, and the four in turn.

Merging and skeletons carry a state from line to line. `scanned` folds over small numbers made from the lines (lengths,
brace counts, whether a line is kept) and gives a mark for each; the text is put together from the marks afterwards, so
no step of the fold copies text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, identifiers, sentences
from .search import spread

#: The size under which blocks are merged, the lines a skeleton keeps, and the marks it leaves.
BLOCK = 500
KEPT = ["//", "/**", "*", "import ", "export "]
DECLARATION = r"^(class|function|interface|type|enum|const|let|var|async)\s"
OMITTED = "  // ... body omitted for brevity"
TRUNCATED = "// ... truncated"
PRESERVED = "// preserved: "
#: Sentences kept without a target, the least with one, and the tokens of a target that stand for one.
SENTENCES, FEWEST, PER_SENTENCE = 5, 3, 20
#: Steps of a fold that are gathered before they join the others.
STRIDE = 256
WHITE = " \t\n\r\x0b\x0c"


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE))


def scanned(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The marks (field `mark` of the state that step gives) of each value in order. The state is a struct; marks are
    gathered by strides, as a growing array is copied whenever something is added. A step adds the mark of the state
    before it, so that it computes its own state only once."""
    none = F.array().cast("array<int>")
    stride = lambda state, part: F.aggregate(part, F.struct(state.alias("state"), none.alias("marks")), lambda a, v: F.struct(step(a["state"], v).alias("state"), F.concat(a["marks"], F.array(a["state"]["mark"])).alias("marks")))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(STRIDE)), lambda i: F.slice(values, i + 1, F.lit(STRIDE)))
    added = lambda a, part: F.transform(F.array(stride(a["state"], part)), lambda x: F.struct(x["state"].alias("state"), F.concat(a["marks"], F.array(x["marks"])).alias("marks")))[0]
    every = F.aggregate(parts, F.struct(first.alias("state"), F.array().cast("array<array<int>>").alias("marks")), added)
    late = F.transform(F.array(every), lambda e: F.concat(F.flatten(e["marks"]), F.array(e["state"]["mark"])))[0]
    return F.slice(late, F.lit(2), F.size(values))


def dedupe(text: Column, target: int | None = None) -> Column:
    """The first of each trimmed line; blank lines all stay. By one sort of (line, place), not by comparing all lines."""
    lines = F.split(text, "\n")
    places = F.sort_array(F.transform(lines, lambda x, i: F.struct(bare(x).alias("key"), i.alias("at"))))
    with_places = lambda s: F.filter(s, lambda x, j: (x["key"] == "") | F.coalesce(x["key"] != F.get(s, j - 1)["key"], F.lit(True)))
    kept = F.transform(F.array(places), with_places)[0]
    return F.array_join(F.transform(F.sort_array(F.transform(kept, lambda x: x["at"])), lambda i: F.get(lines, i)), "\n")


def merge(text: Column, target: int | None = None) -> Column:
    """Blocks between empty lines, a block joined to the group before it while that keeps the two under BLOCK characters.
    Blocks of a group stand one line apart, groups two."""
    blocks = F.when(text.contains("\n\n"), F.split(text, r"\n{2,}")).otherwise(F.array(text))
    nothing, line, gap = 0, 1, 2

    def step(s, n):
        fits = s["size"] + n < BLOCK
        follows = fits & (s["size"] > 0)
        mark = F.when(follows, line).when((n > 0) & (s["out"] > 0), gap).otherwise(nothing)
        size = F.when(follows, s["size"] + 1 + n).otherwise(n)
        return F.struct(size.cast("int").alias("size"), F.greatest(s["out"], (n > 0).cast("int")).alias("out"), mark.cast("int").alias("mark"))

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("out"), F.lit(0).alias("mark"))
    marks = scanned(F.transform(blocks, F.length), start, step)
    return F.array_join(F.zip_with(blocks, marks, lambda b, m: F.concat(F.repeat(F.lit("\n"), m), b)), "")


def skeleton(text: Column, target: int | None = None) -> Column:
    """Comments, imports, exports and declarations, also inside bodies; what else braces enclose goes, up to the line that
    closes them. With a target the result ends after four characters for each of its tokens."""
    lines = F.split(text, "\n")
    gone, kept, opened = 0, 1, 2
    starts = lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in KEPT]) | x.rlike(DECLARATION)
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    # what the fold needs of a line: whether it is kept, whether it opens a brace, and how much deeper it leads
    seen = lambda x: F.struct(starts(x).alias("keep"), x.contains("{").alias("opens"), (count(x, "{") - count(x, "}")).alias("deeper"))

    def step(s, v):
        opens, within = v["keep"] & v["opens"], ~v["keep"] & (s["depth"] > 0) & s["inside"]
        depth = F.when(opens | within, s["depth"] + v["deeper"]).otherwise(s["depth"])
        closes = within & (depth <= 0)
        mark = F.when(opens & (depth > 0), opened).when(v["keep"] | closes, kept).otherwise(gone)
        return F.struct(depth.cast("int").alias("depth"), ((s["inside"] | opens) & ~closes).alias("inside"), mark.cast("int").alias("mark"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("mark"))
    # trimmed first, as an expression given to `seen` is computed wherever it stands there
    marks = scanned(F.transform(F.transform(lines, bare), seen), start, step)
    shown = F.zip_with(lines, marks, lambda x, m: F.when(m == gone, F.array().cast("array<string>")).when(m == kept, F.array(x)).otherwise(F.array(x, F.lit(OMITTED))))
    out = F.array_join(F.flatten(shown), "\n")
    if not target:
        return out
    return F.transform(F.array(out), lambda x: F.when(F.length(x) > 4 * target, F.concat(F.substring(x, 1, 4 * target), F.lit(f"\n{TRUNCATED}"))).otherwise(x))[0]


def last_sentences(text: Column, target: int | None = None) -> Column:
    """The last sentences, untrimmed, joined by a full stop and a blank, with a full stop at the end."""
    n = max(FEWEST, target // PER_SENTENCE) if target else SENTENCES
    s = sentences(text)
    out = F.array_join(F.when(F.size(s) > n, F.slice(s, -n, n)).otherwise(s), ". ")
    return F.when(out.endswith("."), out).otherwise(F.concat(out, F.lit(".")))


def preserve(names: Column, compressed: Column) -> Column:
    """With a line for each identifier that the result has lost; a line that holds a later name serves for it too."""
    lost = F.filter(names, lambda x: ~F.contains(compressed, x))
    return F.concat(compressed, F.aggregate(lost, F.lit(""), lambda t, x: F.when(F.contains(t, x), t).otherwise(F.concat(t, F.lit(f"\n{PRESERVED}"), x))))


STAGES: dict[str, Callable[[Column, int | None], Column]] = {"dedupe": dedupe, "merge": merge, "skeleton": skeleton, "conversation": last_sentences}


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later steps read as values: a generator keeps the optimizer from repeating them in each use."""
    taken = [F.col(c) for c in df.columns if c not in columns]
    return df.select(F.inline(F.array(F.struct(*taken, *(c.alias(n) for n, c in columns.items())))))


def compress(df: DataFrame, text: str = "text", target: int | None = None, stages: list[str] | None = None, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """df with a struct column `result`: the stages in order until one meets the target, then lost identifiers. Null
    texts count as empty ones. `count` makes a column of token counts from one of texts."""
    order = list(STAGES) if stages is None else stages
    whole = F.coalesce(F.col(text), F.lit(""))
    steps = F.array().cast("array<struct<stage:string,tokens_in:bigint,tokens_out:bigint>>")
    x = fixed(spread(df), __now=whole, __all=count(whole), __in=count(whole), __steps=steps, __going=F.lit(True))
    for name in order:
        x = fixed(x, __next=F.when(F.col("__going"), STAGES[name](F.col("__now"), target)).otherwise(F.col("__now")))
        x = fixed(x, __out=count(F.col("__next")))
        done = F.struct(F.lit(name).alias("stage"), F.col("__in").alias("tokens_in"), F.col("__out").alias("tokens_out"))
        more = F.col("__going") & (F.col("__out") > target) if target else F.col("__going")
        x = fixed(x, __steps=F.when(F.col("__going"), F.concat("__steps", F.array(done))).otherwise(F.col("__steps")), __going=more, __now=F.col("__next"), __in=F.col("__out"))
    x = fixed(x, __names=identifiers(whole))
    x = fixed(x, __now=preserve(F.col("__names"), F.col("__now")))
    x = fixed(x, __out=count(F.col("__now")))
    saved = F.greatest(F.col("__all") - F.col("__out"), F.lit(0))
    percent = F.when(F.col("__all") > 0, 100 * saved / F.col("__all")).otherwise(0.0)
    result = F.struct(F.col("__now").alias("compressed"), F.col("__all").alias("original_tokens"), F.col("__out").alias("compressed_tokens"), saved.alias("saved_tokens"), percent.alias("saved_percent"), F.col("__steps").alias("stages"), F.col("__names").alias("identifiers"))
    return x.select(*df.columns, result.alias("result"))


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) of the lines that dedupe keeps, as rows."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("bare", bare(F.col("line")))
    first = lines.where("bare <> ''").groupBy(key, "bare").agg(F.min(F.struct("pos", "line")).alias("m")).select(key, "m.pos", "m.line")
    return lines.where("bare = ''").select(key, "pos", "line").unionByName(first)

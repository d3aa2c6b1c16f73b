"""Text functions as columns: identifier tokenizer, sentences, blocks, paths, identifiers."""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Source file extensions by language.
LANGUAGES = {
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
}


#: What separates runs of identifier characters, where camel case is cut, and what separates path parts.
RUN, GAP = "[a-zA-Z0-9_./-]+", "[^a-zA-Z0-9_./-]"
RUN_GAP = f"{GAP}+"
CAMEL_EDGE = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
PART_GAP = "[./_-]+"
#: Runs without a match are one word: they need no cutting.
COMPOUND = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[./_-]"


def search_terms(text: Column) -> Column:
    """Distinct identifiers and parts of two characters and more, in order of first occurrence: each run of word, dot,
    slash and dash characters in lower case, its camel-case parts and its path parts. Equal runs are cut once."""
    # a blank is split at without a pattern, so only different pieces that hold another gap meet one
    pieces = F.array_distinct(F.split(F.coalesce(text, F.lit("")), " "))
    runs = F.array_distinct(F.flatten(F.transform(pieces, lambda x: F.when(x.rlike(GAP), F.split(x, RUN_GAP)).otherwise(F.array(x)))))
    lower = lambda parts: F.transform(parts, F.lower)
    cut = lambda x: F.concat(F.array(F.lower(x)), lower(F.split(x, CAMEL_EDGE)), lower(F.split(x, PART_GAP)))
    terms = F.flatten(F.transform(runs, lambda x: F.when(x.rlike(COMPOUND), cut(x)).otherwise(F.array(F.lower(x)))))
    return F.array_distinct(F.filter(terms, lambda x: F.length(x) >= 2))


class Terms(dict):
    """Memo of the terms of runs; emptied at a fixed number of entries, so it stays small on any vocabulary."""

    def __missing__(self, run: str) -> tuple[str, ...]:
        if len(self) >= 100_000:
            self.clear()
        cut = [run, *re.split(CAMEL_EDGE, run), *re.split(PART_GAP, run)] if re.search(COMPOUND, run) else [run]
        value = self[run] = tuple(dict.fromkeys(x.lower() for x in cut if len(x) >= 2))
        return value


#: One for all batches of a worker, which are small.
TERMS = Terms()


def listed_terms(texts: pa.Array) -> pa.Array:
    memo, find = TERMS, re.compile(RUN).findall
    return pa.array([list(dict.fromkeys(chain.from_iterable(map(memo.__getitem__, find(t or ""))))) for t in texts.to_pylist()], pa.list_(pa.string()))


def terms_of_texts(text: Column) -> Column:
    """`search_terms` for whole collections, where a pattern for each word in the JVM is what takes the time."""
    return F.arrow_udf(listed_terms, ArrayType(StringType()))(text)


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)]
    return F.coalesce(F.create_map(*pairs)[extension(path)], F.lit("unknown"))


#: Fixed values below: what makes a path one of tests or of documentation.
def is_test(path: Column) -> Column:
    p = F.lower(normal_path(path))
    return p.contains("/test/") | p.contains("/tests/") | p.contains("/__tests__/") | p.rlike(r"\.(test|spec)\.[a-z]+$")


def is_doc(path: Column) -> Column:
    p = F.lower(normal_path(path))
    return p.endswith(".md") | p.endswith(".rst") | p.contains("/docs/")


def snippet_kind(path: Column) -> Column:
    return F.when(is_test(path), "test").when(path.endswith(".md"), "doc").otherwise("code")


def diff_files(diff: Column) -> Column:
    """Paths on the added side of a unified diff (the mark of that side is a fixed value)."""
    return F.array_distinct(F.transform(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1)), normal_path))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s) != "")


#: What counts as an identifier in code: declared names, capitalised names, called names. Words are ASCII
#: words, so their edges are spelt out (a dollar sign is no part of a word: only after one is there an edge before it).
IDENTIFIERS = [
    r"(?<![A-Za-z0-9_])(?:class|interface|type|enum|function|const|let|var)\s+([A-Za-z_$][\w$]*)",
    r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)",
    r"(?:(?<![A-Za-z0-9_])(?=[a-z_])|(?<=[A-Za-z0-9_])(?=\$))([a-z_$][\w$]*)$",
]
#: What stands before an opening bracket, read backwards.
BEFORE = r"^\s*([\w$]+)"


def called(text: Column) -> Column:
    """Called names, in order: the end of what stands before each opening bracket, so that no pattern runs over the text."""
    parts = F.split(text, r"\(")
    ends = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.reverse(F.regexp_extract(F.reverse(x), BEFORE, 1)))
    return F.transform(ends, lambda x: F.regexp_extract(x, IDENTIFIERS[-1], 1))


def identifiers(text: Column) -> Column:
    """Declared names, capitalised names and called names of two characters and more."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in IDENTIFIERS[:-1]), called(text))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def joined_parts(*parts: Column) -> Column:
    """Non-empty parts joined by blanks."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def cache_key(*parts: Column) -> Column:
    """The key of a cached result: its kind and what it depends on, joined by colons."""
    return F.concat_ws(":", *parts)


def request_hash(*fields: Column) -> Column:
    """What tells requests apart: a digest of their fields as JSON, in the order given, nulls included."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)

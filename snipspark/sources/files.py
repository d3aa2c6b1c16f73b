"""Source trees as a table of files: recursive scan, ignore rules, size cap, language, digest.

The listing is the engine's own: Spark's file sources leave out names that begin with a dot or an underscore, which in
source trees are files like any other. The driver lists folders until there are enough for all tasks, each task then
walks the trees under its own; ignored folders are never entered, and contents are read only for files that are kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of

#: What is never indexed, and the largest file in bytes.
IGNORED = ["node_modules", ".git", "dist", "build", "coverage", ".turbo", ".data", "*.min.js", "*.map"]
LARGEST = 1_000_000
#: Folders that the driver lists before tasks go on, tasks that walk the rest; bytes of contents that a task hands on at once.
FAN, TASKS, PIECE = 256, 4096, 16 << 20
LISTED = "path string, size long, mtime_ms long"


def pattern(rule: str) -> str:
    """A rule's regular expression: one star stays within a folder, two cross folders."""
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            inner = rule[i + 1 : end].replace("\\", r"\\")
            out, i = out + ("[^" + inner[1:] if inner[0] in "!^" else "[" + inner) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(rule[i], re.escape(rule[i])), i + 1
    return out


class Rules:
    """Ignore rules in gitignore's manner; the last rule that matches decides, and nothing under an ignored folder comes back."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            folders, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.removeprefix("/")
            self.rules.append((keep, folders, re.compile(pattern(line) if anchored else f"(?:.*/)?{pattern(line)}", re.S)))

    def hit(self, path: str, folder: bool) -> bool:
        """Whether the rules leave out this path, whatever becomes of the folders above it."""
        out = False
        for keep, folders, wanted in self.rules:
            if (folder or not folders) and wanted.fullmatch(path):
                out = not keep
        return out

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        return any(self.hit("/".join(parts[:n]), n < len(parts)) for n in range(1, len(parts) + 1))


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    system, base = arrow_fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (arrow_fs.LocalFileSystem(), root)
    return system, base.rstrip("/")


def listed(system, base: str, folder: str, rules: Rules) -> tuple[list[str], list[tuple]]:
    """The folders and the files (path, size, mtime_ms) of one folder that the rules leave, by paths relative to base."""
    folders, found = [], []
    for info in system.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
        path, is_folder = f"{folder}/{info.base_name}".lstrip("/"), info.type == arrow_fs.FileType.Directory
        if rules.hit(path, is_folder):
            continue
        if is_folder:
            folders.append(path)
        else:
            found.append((path, info.size, info.mtime_ns // 1_000_000 if info.mtime_ns else 0))
    return folders, found


def listing(spark: SparkSession, root: str, rules: Rules) -> DataFrame:
    """(path, size, mtime_ms) of all files that the rules leave."""
    system, base = opened(root)
    open_, top = [""], []
    while open_ and len(open_) < FAN:
        deeper = []
        for folder in open_:
            folders, found = listed(system, base, folder, rules)
            deeper += folders
            top += found
        open_ = deeper

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(root)
        for b in batches:
            stack = list(b["folder"])
            while stack:
                folders, found = listed(system, base, stack.pop(), rules)
                stack += folders
                yield pd.DataFrame(found, columns=["path", "size", "mtime_ms"])

    head = spark.createDataFrame(top, LISTED)
    if not open_:
        return head
    rest = spark.createDataFrame([(f,) for f in open_], "folder string").repartition(min(len(open_), TASKS)).mapInPandas(walk, LISTED)
    return head.unionByName(rest)


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, documents: bool = False) -> DataFrame:
    """(path, hash, size, language, mtime_ms, content) of the source files under a folder, hidden names included. The
    root's .gitignore applies. Contents are UTF-8, bytes that aren't become U+FFFD. With documents, Markdown files are
    kept as language `markdown`."""
    system, base = opened(root)
    own = f"{base}/.gitignore"
    text = ""
    if system.get_file_info(own).type == arrow_fs.FileType.File:
        with system.open_input_file(own) as f:
            text = f.read().decode("utf-8", "replace")
    all_rules = Rules([*IGNORED, *(rules or []), *text.splitlines()])
    language = language_of(F.col("path"))
    if documents:
        language = F.when(F.lower("path").endswith(".md"), "markdown").otherwise(language)
    kept = listing(spark, root, all_rules).where(F.col("size") <= LARGEST).withColumn("language", language).where("language <> 'unknown'")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(root)
        for b in batches:
            lo = size = 0
            contents = []
            for i, path in enumerate(b["path"]):
                with system.open_input_file(f"{base}/{path}") as f:
                    contents.append(f.read().decode("utf-8", "replace"))
                size += len(contents[-1])
                if size >= PIECE or i + 1 == len(b):
                    yield b.iloc[lo : i + 1].assign(content=contents)
                    lo, size, contents = i + 1, 0, []

    dealt = kept.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("path"))
    return dealt.mapInPandas(read, f"{LISTED}, language string, content string").select("path", F.sha2("content", 256).alias("hash"), "size", "language", "mtime_ms", "content")

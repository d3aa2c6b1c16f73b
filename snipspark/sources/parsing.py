"""Source files to symbols, imports, references and chunks: a table function over files.

Python is parsed with its own `ast`. The other languages go through one scanner: declaration patterns, strings and
comments blanked out, and braces matched, which finds the declarations of usual code but is no grammar: macros,
templates and declarations that span odd lines can be missed. Names, ranges (0-based, end included), scopes and
chunk texts follow one set of rules for all languages. Ids are digests of what they name, so a task that runs again
gives the same rows."""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "id string, name string, kind string, file_path string, start_line int, end_line int, start_column int, end_column int, signature string, documentation string, parent_id string, language string, exported boolean"
IMPORT = "id string, file_path string, source string, imported_names array<string>, is_default boolean, line int"
REFERENCE = "id string, from_symbol_id string, to_name string, kind string, file_path string, line int"
CHUNK = "id string, symbol_id string, file_path string, content string, hash string, language string, ord long, symbol_name string, symbol_kind string, signature string, parent_id string, start_line int, end_line int"
PARSED = f"path string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<{IMPORT.replace(' ', ':').replace(',:', ',')}>>, refs array<struct<{REFERENCE.replace(' ', ':').replace(',:', ',')}>>, chunks array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>, error string"
SCOPES = ("class", "struct", "interface")
#: Characters of a documentation and of a signature that are kept.
DOCUMENTATION, SIGNATURE = 500, 200
#: Declarations by language: kind and a pattern whose group is the name; the first that matches a line counts.
BRACED = {
    "typescript": [("class", r"(?:abstract\s+)?class\s+(\w+)"), ("interface", r"interface\s+(\w+)"), ("enum", r"(?:const\s+)?enum\s+(\w+)"), ("type", r"type\s+(\w+)[^=]*="), ("function", r"(?:async\s+)?function\s*\*?\s*(\w+)"), ("variable", r"(?:const|let)\s+(\w+)"), ("method", r"(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?!(?:if|for|while|switch|catch|return|function|new|await|throw|else|do)\b)([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;=]+)?\{")],
    "go": [("struct", r"type\s+(\w+)\s+struct"), ("interface", r"type\s+(\w+)\s+interface"), ("method", r"func\s*\([^)]*\)\s*(\w+)"), ("function", r"func\s+(\w+)")],
    "rust": [("struct", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("class", r"impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)")],
    "java": [("class", r"(?:\w+\s+)*class\s+(\w+)"), ("interface", r"(?:\w+\s+)*interface\s+(\w+)"), ("enum", r"(?:\w+\s+)*enum\s+(\w+)"), ("method", r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?!(?:return|new|else|throw)\b)[\w<>\[\], ]+\s+(?!(?:if|for|while|switch|catch)\b)(\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{")],
    "c": [("struct", r"(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("enum", r"enum\s+(\w+)"), ("function", r"(?!(?:return|else|typedef)\b)[A-Za-z_][\w\s*]*?[\s*](?!(?:if|for|while|switch)\b)(\w+)\s*\([^;]*\)\s*\{")],
}
BRACED |= {"javascript": BRACED["typescript"], "cpp": [("class", r"class\s+(\w+)"), *BRACED["c"]]}
PATTERNS = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in BRACED.items()}
NOT_CODE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
WORD = re.compile(r"[A-Za-z_$][\w$]*")
OPENS = re.compile(r"\s*\{")
RESERVED = frozenset("if for while switch catch return function new await async throw else do const let var class interface enum type import export from default extends implements public private protected static readonly this super true false null undefined void string number boolean any struct func fn pub impl package use mod int long float double char final try in of def self break continue typeof".split())


def ident(prefix: str, *parts) -> str:
    return f"{prefix}:{hashlib.sha256(chr(31).join(map(str, parts)).encode()).hexdigest()}"


def blanked(text: str) -> str:
    """The text with comments and strings replaced by blanks of the same length and lines."""
    return NOT_CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(code: str, start: int) -> int:
    """Where the block or statement that begins at start ends."""
    depth, braced, content = 0, False, False
    for i in range(start, len(code)):
        c = code[i]
        if c in "{([":
            depth += 1
            braced |= c == "{"
        elif c in "})]":
            depth -= 1
            if depth <= 0 and c == "}":
                return i
            if depth < 0:
                return i - 1
        elif c == ";" and depth == 0:
            return i
        elif c == "\n" and depth == 0 and content and not braced and not OPENS.match(code, i):
            return i - 1
        content |= not c.isspace()
    return len(code) - 1


class Nest:
    """Ranges (start, end) in the order of their starts, as a sweep meets them: which of them hold a place."""

    def __init__(self):
        self.open: list[dict] = []

    def at(self, place: int) -> list[dict]:
        """The ranges that hold a place, outer ones first; places must not decrease."""
        self.open = [d for d in self.open if d["end"] >= place]
        return self.open


def scanned(language: str, text: str) -> list[dict]:
    """Declarations in order: name, kind, start, end (offsets), exported, depth by enclosing ranges."""
    code, found, nest = blanked(text), [], Nest()
    at = 0
    for line in code.split("\n"):
        bare = line.lstrip()
        lead = len(line) - len(bare)
        head = re.match(r"(?:export\s+)?(?:default\s+)?", bare)[0] if language in ("typescript", "javascript") else ""
        for kind, pattern in PATTERNS[language]:
            m = pattern.match(bare, len(head))
            if not m:
                continue
            inside = nest.at(at + lead)
            if kind == "method" and not any(d["kind"] in SCOPES for d in inside) and language != "go":
                continue
            if kind == "method" and any(d["kind"] in ("method", "function") for d in inside):
                continue
            start = at + lead + len(head)
            found.append({"name": m[1], "kind": kind, "start": start, "end": closing(code, start), "exported": head.startswith("export") or any(d["exported"] for d in inside)})
            nest.open.append(found[-1])
            break
        at += len(line) + 1
    return found


def python_found(text: str) -> list[dict]:
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            end = starts[node.end_lineno - 1] + len(lines[node.end_lineno - 1].encode()[: node.end_col_offset].decode(errors="ignore")) - 1
            out.append({"name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "start": starts[node.lineno - 1] + node.col_offset, "end": end, "exported": False})
    return sorted(out, key=lambda d: d["start"])


def comments(language: str, text: str) -> tuple[list[int], list[str]]:
    """The ends and the texts of all comments, in order."""
    if language == "python":
        found = list(re.finditer(r"^[ \t]*(#[^\n]*)", text, re.M))
        return [m.end() for m in found], [m[1] for m in found]
    found = [m for m in NOT_CODE.finditer(text) if m[0].startswith(("//", "/*"))]
    return [m.end() for m in found], [m[0] for m in found]


def found_imports(language: str, path: str, text: str) -> list[dict]:
    """Imports with their source, names and whether the default is taken."""
    out = []

    def add(source, names, default, line):
        out.append({"id": ident("imp", path, source, line, *names), "file_path": path, "source": source, "imported_names": names, "is_default": default, "line": line})

    if language == "python":
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.ImportFrom):
                add("." * node.level + (node.module or ""), [a.name for a in node.names], False, node.lineno - 1)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    add(a.name, [], True, node.lineno - 1)
        return out
    patterns = {"go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$', "java": r"^\s*import\s+(?:static\s+)?([\w.*]+);", "rust": r"^\s*use\s+([\w:]+)", "c": r'^\s*#include\s+[<"]([^>"]+)', "cpp": r'^\s*#include\s+[<"]([^>"]+)'}
    if language in patterns:
        inside = False
        for i, line in enumerate(text.split("\n")):
            inside = language != "go" or line.startswith("import") or (inside and not line.startswith(")"))
            if inside and (m := re.match(patterns[language], line)):
                add(m[1], [], False, i)
        return out
    line, seen = 0, 0
    for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?(?:([^;\"'()]+?)\s+from\s+)?[\"']([^\"'\n]+)[\"']", text, re.M):
        clause = m[1] or ""
        named = re.search(r"\{([^}]*)\}", clause)
        names = [re.split(r"\s+as\s+", n.strip())[0] for n in (named[1].split(",") if named else []) if n.strip()]
        lone = re.match(r"([A-Za-z_$][\w$]*)", clause)
        line, seen = line + text.count("\n", seen, m.start()), m.start()
        add(m[2], names + ([lone[1]] if lone else []), bool(lone), line)
    return out


def parsed_file(path: str, language: str, text: str, fine_scopes: bool = False) -> dict:
    """A file's rows. With fine_scopes functions and methods own their references too, not only classes."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    if language == "markdown":
        declared = [{"name": lines[i].lstrip("# ").strip() or path, "kind": "section", "start": starts[i], "end": 0, "exported": True} for i in range(len(lines)) if i == 0 or re.match(r"#{1,6}\s", lines[i])]
        for d, after in zip(declared, [*declared[1:], {"start": len(text) + 1}]):
            d["end"] = max(after["start"] - 2, d["start"])
    else:
        declared = python_found(text) if language == "python" else scanned(language, text)
    row = lambda at: bisect_right(starts, at, hi=len(lines)) - 1
    ends, said = comments(language, text) if language != "markdown" else ([], [])
    scopes = Nest()
    symbols, chunks = [], []
    for d in declared:
        first, last = row(d["start"]), row(max(d["end"], d["start"]))
        outer = list(scopes.at(d["start"]))
        parent = outer[-1]["id"] if outer else None
        kind = "method" if d["kind"] == "function" and language == "python" and outer and outer[-1]["kind"] == "class" else d["kind"]
        if d["kind"] in SCOPES:
            scopes.open.append(d)
        d["id"] = ident("sym", path, kind, d["name"], first, d["start"] - starts[first])
        # the comment that only white space parts from the declaration's line
        k = bisect_right(ends, starts[first]) - 1
        doc = said[k][:DOCUMENTATION] if k >= 0 and not text[ends[k] : starts[first]].strip() else None
        signature = lines[first].strip()[:SIGNATURE]
        symbols.append({"id": d["id"], "name": d["name"], "kind": kind, "file_path": path, "start_line": first, "end_line": last, "start_column": d["start"] - starts[first], "end_column": d["end"] + 1 - starts[last], "signature": signature, "documentation": doc, "parent_id": parent, "language": language, "exported": d["exported"]})
        # fixed values: the lines at the head of a chunk
        header = [f"// File: {path}", f"// Symbol: {d['name']} ({kind})", *([f"// Signature: {signature}"] if signature else [])]
        content = "\n".join([*header, *lines[first : last + 1]])
        chunks.append({"id": ident("chunk", path, d["id"]), "symbol_id": d["id"], "file_path": path, "content": content, "hash": hashlib.sha256(content.encode()).hexdigest(), "language": language, "ord": len(chunks), "symbol_name": d["name"], "symbol_kind": kind, "signature": signature, "parent_id": parent, "start_line": first, "end_line": last})
    refs = []
    owners = [d for d in declared if d["kind"] in SCOPES or fine_scopes] if language != "markdown" else []
    code = blanked(text) if owners else ""
    for kind, pattern in (("call", CALL), ("read", WORD)):
        nest, waiting = Nest(), iter([*owners, None])
        ahead = next(waiting)
        for m in pattern.finditer(code):
            while ahead and ahead["start"] <= m.start():
                nest.open.append(ahead)
                ahead = next(waiting)
            around = nest.at(m.start())
            name = m[1] if kind == "call" else m[0]
            if around and name.split(".")[0] not in RESERVED - {"this", "self"} and name not in RESERVED and name != around[-1]["name"]:
                refs.append({"id": ident("ref", path, kind, m.start()), "from_symbol_id": around[-1]["id"], "to_name": name, "kind": kind, "file_path": path, "line": row(m.start())})
    return {"path": path, "symbols": symbols, "imports": found_imports(language, path, text) if language != "markdown" else [], "refs": refs, "chunks": chunks, "error": None}


def parse(files: DataFrame, fine_scopes: bool = False) -> DataFrame:
    """One row for each file (path, language, content): arrays of its symbols, imports, refs and chunks; a file that can't be parsed has none and says why."""

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, text in zip(b["path"], b["language"], b["content"]):
                try:
                    out.append(parsed_file(path, language, text or "", fine_scopes))
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append({"path": path, "symbols": [], "imports": [], "refs": [], "chunks": [], "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(out, columns=["path", "symbols", "imports", "refs", "chunks", "error"])

    return files.select("path", "language", "content").mapInPandas(stage, PARSED)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One of symbols, imports, refs and chunks as rows."""
    return parsed.select(F.inline(name))

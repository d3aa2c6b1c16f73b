"""The parser on small sources of each way of reading: braces, indentation, headings; diffs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from snipspark.functions import text as T
from snipspark.sources import parsing

SOURCES = {
    "src/cart.ts": ("typescript", 'import { Price } from "./price";\nimport tax from "../tax.js";\n\n/**\n * Holds lines.\n */\nexport class Cart {\n  private total = 0;\n\n  add(line: Line): number {\n    return this.sum(line.price);\n  }\n}\n\ninterface Line { price: Price }\nexport function empty(): Cart {\n  return new Cart();\n}\n'),
    "lib/shop.py": ("python", "from cart.base import Cart, Line\nimport os\n\n\nclass Shop:\n    def open(self):\n        return Cart(os.name)\n\n\n# closes all\ndef close(shop):\n    shop.close()\n"),
    "cmd/main.go": ("go", 'package main\n\nimport (\n\t"fmt"\n)\n\ntype Till struct {\n\tn int\n}\n\n// ring\nfunc (t *Till) Ring() {\n\tfmt.Println(t.n)\n}\n'),
    "docs/use.md": ("markdown", "Intro\n# Start\nRun it.\n## More\nRead.\n"),
}

SYMBOLS = [
    ("src/cart.ts", "Cart", "class", 6, 12, True, "/**\n * Holds lines.\n */", None, "export class Cart {"),
    ("src/cart.ts", "add", "method", 9, 11, True, None, "Cart", "add(line: Line): number {"),
    ("src/cart.ts", "Line", "interface", 14, 14, False, None, None, "interface Line { price: Price }"),
    ("src/cart.ts", "empty", "function", 15, 17, True, None, None, "export function empty(): Cart {"),
    ("lib/shop.py", "Shop", "class", 4, 6, False, None, None, "class Shop:"),
    ("lib/shop.py", "open", "method", 5, 6, False, None, "Shop", "def open(self):"),
    ("lib/shop.py", "close", "function", 10, 11, False, "# closes all", None, "def close(shop):"),
    ("cmd/main.go", "Till", "struct", 6, 8, False, None, None, "type Till struct {"),
    ("cmd/main.go", "Ring", "method", 11, 13, False, "// ring", None, "func (t *Till) Ring() {"),
    ("docs/use.md", "Intro", "section", 0, 0, True, None, None, "Intro"),
    ("docs/use.md", "Start", "section", 1, 2, True, None, None, "# Start"),
    ("docs/use.md", "More", "section", 3, 4, True, None, None, "## More"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([(p, *v) for p, v in SOURCES.items()], "path string, language string, content string")
    return lambda name: parsing.table(parsing.parse(files), name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_symbols(parsed):
    s = parsed("symbols")
    outer = s.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    got = s.join(outer, "parent_id", "left").select("file_path", "name", "kind", "start_line", "end_line", "exported", "documentation", "parent", "signature")
    assert rows(got) == sorted(SYMBOLS, key=str)


def test_imports(parsed):
    got = parsed("imports").select("file_path", "source", F.array_join("imported_names", ",").alias("names"), "is_default", "line")
    assert rows(got) == sorted([("src/cart.ts", "./price", "Price", False, 0), ("src/cart.ts", "../tax.js", "tax", True, 1), ("lib/shop.py", "cart.base", "Cart,Line", False, 0), ("lib/shop.py", "os", "", True, 1), ("cmd/main.go", "fmt", "", False, 3)], key=str)


def test_calls(parsed):
    names = parsed("symbols").select(F.col("id").alias("from_symbol_id"), F.col("name").alias("caller"))
    got = parsed("refs").where("kind = 'call'").join(names, "from_symbol_id").select("file_path", "caller", "to_name", "line")
    assert rows(got) == sorted([("src/cart.ts", "Cart", "add", 9), ("src/cart.ts", "Cart", "this.sum", 10), ("lib/shop.py", "Shop", "open", 5), ("lib/shop.py", "Shop", "Cart", 6)], key=str)


def test_chunks(parsed):
    want = []
    for path, name, kind, start, end, _, _, _, signature in SYMBOLS:
        content = "\n".join([f"// File: {path}", f"// Symbol: {name} ({kind})", f"// Signature: {signature}", *SOURCES[path][1].split("\n")[start : end + 1]])
        want.append((path, name, start, content, hashlib.sha256(content.encode()).hexdigest()))
    assert rows(parsed("chunks").select("file_path", "symbol_name", "start_line", "content", "hash")) == sorted(want, key=str)


def test_files_of_a_diff(spark):
    diff = "--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1 +1 @@\n+x\n--- /dev/null\n+++ b/docs/x y.md\n+++ b/src/a.ts"
    assert spark.createDataFrame([(diff,)], "d string").select(T.diff_files(F.col("d"))).first()[0] == ["src/a.ts", "docs/x y.md"]


def test_keys_of_caches_and_requests(spark):
    df = spark.createDataFrame([("repo", "h", None), ("repo", "h", 1)], "a string, b string, c int")
    key, one, other = df.select(T.cache_key(F.lit("retrieval"), F.col("a"), F.col("b"))).first()[0], *(r[0] for r in df.select(T.request_hash(F.col("a"), F.col("c"))).collect())
    assert key == "retrieval:repo:h" and one != other
    assert one == hashlib.sha256(b'{"a":"repo","c":null}').hexdigest()

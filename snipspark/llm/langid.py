"""Language identification in two levels: the language family first, then one-versus-one linear SVMs within it.

Features are the byte 1- to 4-grams of each word between boundary marks, hashed to DIMS places, in shares of a text's
total. Everything is linear in the words, so a task scores each distinct word once, keeps the scores in a bounded memo
and averages them over the whole text. Models are fitted by dual coordinate descent on a bounded sample of labelled
rows (at most PER_LANGUAGE rows of each language, the least by a hash of the doc_id, whole texts).

Cases: null texts and texts without a letter get `und` and score 0. A language outside the table of families is its own
family. With one learned language every text with letters gets it; with none all get `und`. Rows with null lang are not
learned from. Repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, frugal, pieces, small_batches, text_bytes

UND = "und"
DIMS = 1 << 14
GRAMS = (1, 2, 3, 4)
#: Bound of the sample that models are fitted on: rows of each language.
PER_LANGUAGE = 400
SCALE = 30.0
#: Score under which the pipeline's stage takes a language as not identified.
LEAST = 0.25
MEMO = 200_000
#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-iranian": "hi ur bn fa pa gu mr ne".split(),
    "cjk": "zh ja ko".split(),
    "semitic": "ar he mt am".split(),
}
#: White space, digits and ASCII signs become blanks; A-Z become small.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Candidates for letters; Unicode numbers such as fractions are among them and aren't letters.
LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0] in langs), lang)


def has_letter(text: bytes) -> bool:
    return bool(text) and (re.search(rb"[A-Za-z]", text) is not None or any(m[0].isalpha() for m in LETTER.finditer(text.decode("utf-8", "replace"))))


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all grams of the words, word by word, and how many each word has."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    n = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), n + 1)
    owner = np.append(owner, len(words) - 1)
    blank = raw == 32
    places, owners = [], []
    for size in GRAMS:
        if len(raw) < size:
            continue
        m = len(raw) - size + 1
        h = np.full(m, size, np.uint32)
        inner = np.zeros(m, bool)
        for k in range(size):
            h = (h * np.uint32(0x01000193)) ^ (raw[k : k + m] * np.uint32(0x9E3779B1))
            if 0 < k < size - 1:
                inner |= blank[k : k + m]
        h ^= h >> np.uint32(15)
        ok = ~inner if size > 1 else ~blank[:m]
        if size == 2:
            ok &= ~(blank[:m] & blank[1 : m + 1])
        places.append((h & np.uint32(DIMS - 1))[ok])
        # the mark before a word is its own, so a gram that begins there is too
        owners.append(owner[:m][ok])
    place, own = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return place[order], np.bincount(own, minlength=len(words))


def text_shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's features that aren't 0: places and shares of its grams, with the bias at the end."""
    words = text.translate(TABLE).split()
    place = word_grams(words)[0] if words else np.zeros(0, np.int64)
    at, n = np.unique(place, return_counts=True)
    return np.append(at, DIMS), np.append(n / max(len(place), 1) * SCALE, 1.0)


def svm(held: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """A linear SVM (L1 loss, the last weight is the bias) by dual coordinate descent over sparse rows."""
    w, alpha, norms = np.zeros(DIMS + 1), np.zeros(len(held)), [(v * v).sum() for _, v in held]
    order = np.random.RandomState(7)
    for _ in range(rounds):
        for i in order.permutation(len(held)):
            at, v = held[i]
            g = y[i] * (w[at] * v).sum() - 1
            a = min(max(alpha[i] - g / max(norms[i], 1e-9), 0), c)
            if a != alpha[i]:
                w[at] += (a - alpha[i]) * y[i] * v
                alpha[i] = a
    return w


class Model:
    """Weights of all linear classifiers side by side, and how their values make a language."""

    def __init__(self, x: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(lang) for lang in self.langs})
        lang = np.array(langs)
        fam = np.array([family(lang) for lang in langs])
        columns = []
        if len(self.families) > 1:
            columns += [svm(x, np.where(fam == f, 1, -1)) for f in self.families]
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family(a) == family(b)]
        for a, b in self.pairs:
            rows = (lang == a) | (lang == b)
            columns.append(svm([x[k] for k in np.flatnonzero(rows)], np.where(lang[rows] == a, 1, -1)))
        w = np.stack(columns, 1) if columns else np.zeros((DIMS + 1, 0))
        self.weights, self.bias = w[:-1].astype(np.float32), w[-1]

    def values(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return sums / np.maximum(grams, 1)[:, None] * SCALE + self.bias

    def decide(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the language in langs and a score from 0 to 1, for each row of classifier values."""
        n, f = len(values), len(self.families)
        sure = 1 / (1 + np.exp(-np.clip(2 * values, -30, 30)))
        fam = values[:, :f].argmax(1) if f > 1 else np.zeros(n, np.int64)
        share = sure[:, :f] / np.maximum(sure[:, :f].sum(1, keepdims=True), 1e-9) if f > 1 else np.ones((n, 1))
        votes, belief = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        at = {lang: i for i, lang in enumerate(self.langs)}
        for k, (a, b) in enumerate(self.pairs):
            p = sure[:, (f if f > 1 else 0) + k]
            for lang, q in ((a, p), (b, 1 - p)):
                votes[:, at[lang]] += q >= 0.5
                belief[:, at[lang]] += q
        rivals = np.array([sum(family(x) == family(lang) for x in self.langs) - 1 for lang in self.langs])
        belief = np.where(rivals > 0, belief / np.maximum(rivals, 1), 1.0)
        inside = np.array([self.families.index(family(lang)) for lang in self.langs])
        best = np.where(inside[None] == fam[:, None], votes + belief * 0.5, -1).argmax(1)
        return best, share[np.arange(n), fam] * belief[np.arange(n), best]


def share_stage(batches):
    """Whole texts to their features; texts without a letter are left out."""
    for b in batches:
        for t, lang in zip(text_bytes(b.column("text")), b.column("lang").to_pylist()):
            if has_letter(t):
                at, v = text_shares(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["lang", "at", "v"])


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """The features of at most per_language labelled rows of each language; ids first, then the texts of the chosen.
    What comes to the driver is bounded by rows times DIMS, however long the texts."""
    ids = docs.where("lang is not null and text is not null").select("doc_id", "lang").distinct()
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("n") <= per_language)
    rows = docs.join(F.broadcast(ranked.select("doc_id", "lang")), ["doc_id", "lang"]).select("doc_id", "lang", "text").dropDuplicates(["doc_id", "lang"])
    found = rows.select("lang", "text").mapInArrow(frugal(share_stage), "lang string, at binary, v binary").orderBy("lang", "at", "v").collect()
    return [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float64)) for r in found], [r["lang"] for r in found]


def predict_stage(model):
    def stage(batches):
        m = model.value
        if not m.langs:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([UND] * b.num_rows), pa.array(np.zeros(b.num_rows))], ["row", "lang_pred", "score"])
            return
        memo, k = {}, m.weights.shape[1]
        sums, grams = np.zeros((MEMO, k), np.float32), np.zeros(MEMO, np.int64)
        for b in batches:
            texts = text_bytes(b.column("text"))
            langs, scores = [], []
            for lo, hi in pieces(texts, PIECE):
                words = [t.translate(TABLE).split() if t else [] for t in texts[lo:hi]]
                distinct = set(chain.from_iterable(words))
                fresh = [w for w in distinct if w not in memo]
                if len(memo) + len(fresh) > MEMO:
                    memo.clear()
                    fresh = list(distinct)
                if len(fresh) > len(sums):
                    sums, grams = np.zeros((len(fresh), k), np.float32), np.zeros(len(fresh), np.int64)
                if fresh:
                    first = len(memo)
                    place, n = word_grams(fresh)
                    at = np.append(0, np.cumsum(n))
                    run = np.zeros((len(place) + 1, k))
                    np.cumsum(m.weights[place], axis=0, dtype=np.float64, out=run[1:])
                    sums[first : first + len(fresh)] = run[at[1:]] - run[at[:-1]]
                    grams[first : first + len(fresh)] = n
                    memo.update(zip(fresh, range(first, first + len(fresh))))
                count = np.array([len(w) for w in words])
                index = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
                at = np.append(0, np.cumsum(count))
                total, of = np.zeros((len(words), k)), np.zeros(len(words), np.int64)
                for d in range(len(words)):
                    i = index[at[d] : at[d + 1]]
                    total[d], of[d] = sums[i].sum(0, dtype=np.float64), grams[i].sum()
                best, score = m.decide(m.values(total, of))
                for d in range(len(words)):
                    known = has_letter(texts[lo + d])
                    langs.append(m.langs[best[d]] if known else UND)
                    scores.append(float(score[d]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return stage


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    return Model(*sample(docs, per_language))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns), lang_pred and score, for each row of docs; only text is looked at."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.struct(*docs.columns).alias("row"), "text")
    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(frugal(predict_stage(known)), f"row {row}, lang_pred string, score double")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def learned(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(~held_out(), F.lit(True))).select("doc_id", "text", "lang")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit(learned(docs)))
    return out.select("row.doc_id", F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows whose language is identified, with their columns, of which lang becomes the language predicted. Rejected
    are texts without a letter (null and empty ones too) and those whose score is below `least`. Rows that repeat are
    judged alike; an empty table stays empty; where no language is learned nothing is identified."""
    kept = predict(docs, fit(learned(docs))).where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return kept.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))

"""What the Python stages hold at once, and that they give it back: a worker lives on beside those of later stages."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from snipspark.llm import common, jaccard_join, langid, substrings
from snipspark.llm import pieces as sentencepiece


def texts(n_bytes):
    """Texts of words that hardly repeat."""
    rng, out, size = random.Random(5), [], 0
    while size < n_bytes:
        out.append(" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 11))) for _ in range(600)))
        size += len(out[-1])
    return out


def batch(n_bytes=3 << 20):
    found = texts(n_bytes)
    ids = pa.array(range(len(found)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(found)], ["doc_id", "uid", "row", "text"])


def peak(stage, given):
    """MB that the stage holds at most beside its input, without what Arrow holds."""
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in stage(iter([given])))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def identifier():
    x = [langid.text_shares(t) for t in (b"the cat and the dog", b"der hund und die katze", b"le chat et le chien", b"el gato y el perro")]
    return langid.predict_stage(SimpleNamespace(value=langid.Model(x, ["en", "de", "fr", "es"])))


def tokens():
    return sentencepiece.token_stage(SimpleNamespace(value=sentencepiece.Vocabulary()), True)


@pytest.mark.parametrize("stage, most", [(identifier, 160), (tokens, 160)])
def test_a_batch_of_many_words_takes_little(stage, most):
    given = batch()
    rows, mb = peak(stage(), given)
    assert rows == given.num_rows and mb < most


def test_a_words_grams_are_its_own():
    """What a word is worth, and so a text's language, doesn't depend on the words and texts beside it."""
    words = [b"the", b"a", b"katze", b"chien", b"x"]
    place, n = langid.word_grams(words)
    for w, grams in zip(words, np.split(place, np.cumsum(n)[:-1])):
        assert sorted(grams) == sorted(langid.word_grams([w])[0])


def test_languages_do_not_depend_on_pieces(monkeypatch):
    given, found = batch(1 << 16), []
    for piece in (1, 1 << 13, 1 << 20):
        monkeypatch.setattr(langid, "PIECE", piece)
        out = pa.Table.from_batches(list(identifier()(iter([given]))))
        found.append((out.column("lang_pred").to_pylist(), out.column("score").to_numpy()))
    assert all(x[0] == found[0][0] and np.allclose(x[1], found[0][1], rtol=0, atol=1e-5) for x in found)


def test_counts_leave_in_small_batches(monkeypatch):
    given = batch(1 << 20)
    whole = list(jaccard_join.count_stage(64)(iter([given])))
    monkeypatch.setattr(jaccard_join, "SENT", 5_000)
    small = list(jaccard_join.count_stage(64)(iter([given])))
    assert len(small) > 10 and max(b.nbytes for b in small) < 200_000
    assert sum((b.to_pylist() for b in small), []) == sum((b.to_pylist() for b in whole), [])


def test_words_hash_as_they_are_cut(monkeypatch):
    """The words of a text are those of bytes.split(), with or without their case, whatever their length."""
    odd = [b"a\tB\x0b\x0cc  A", b"", None, b"  \n", b"x" * 300 + b" " + b"X" * 300 + b" x", "é É é".encode(), b"\x00 \x00\x00 a"]
    for lower in (False, True):
        h, at = common.word_hashes(odd, lower)
        cut = [(t.lower() if lower else t).split() if t else [] for t in odd]
        assert np.diff(at).tolist() == [len(c) for c in cut]
        of = {}
        for word, x in zip(sum(cut, []), h.tolist()):
            assert of.setdefault(word, x) == x
        assert len(set(of.values())) == len(of)


def test_stages_give_memory_back(spark, monkeypatch):
    """Every Python stage of the pipeline's operators that reads texts ends by giving its memory back."""
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    given = []
    frame = type(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, put=frame.mapInArrow: (given.append(f), put(self, f, schema, *a))[1])
    langid.identified(docs)
    sentencepiece.tokenised(docs)
    substrings.dedup_substrings(docs)
    assert len(given) == 4
    assert all(f.__qualname__ == common.frugal(None).__qualname__ for f in given)

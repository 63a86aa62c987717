import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaystone.llm import pieces, tokencount, vocabulary
from quaystone.llm.queries import QUERIES, table
from quaystone.llm.text import portions

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary.MODEL), reason="no vocabulary file")
EDGES = [None, "", "a", "  a  b   ", "\n\n x\ny\n", "Hello wörld 日本 ☃𐍈\x00 z", "▁a▁▁b", "a\t\tb\r\n", " lead", "trail ", "x" * 5000, "ab" * 3000, "w " * 20000]


def texts():
    r = random.Random(7)
    letters = "abcdefgh ▁\n\t.ñéß日☃🎉019-"
    return EDGES + ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary.MODEL)


def test_ids_equal_the_library(library):
    own = pieces.Encoder(vocabulary.load())
    got = [np.frombuffer(i, np.int32).tolist() for i in own.encode(texts())]
    assert got == [library.encode(t or "") for t in texts()]
    assert [own.decode(i).decode() for i in got] == [(t or "").replace("▁", " ") for t in texts()]


def test_suffix_array():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        codes = r.integers(1, 4, n).astype(np.uint32)
        order = pieces.suffix_array(pieces.packed(codes), 16)
        keys = [tuple(codes[i : i + 16]) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))


def unigram():
    """A Unigram tokenizer of the same pieces and scores, as the library builds it."""
    from tokenizers import Tokenizer, models

    v = vocabulary.load()
    low = min(v.scores.values())
    names = [p if p else (f"<0x{i - v.bytes_from:02X}>" if v.bytes_from <= i < v.bytes_from + 256 else f"<{i}>", low) for i, p in enumerate(v.pieces)]
    return Tokenizer(models.Unigram(names, v.unknown, True)).model


def test_counts_equal_a_unigram_tokenizer():
    model, own = unigram(), tokencount.Counter(vocabulary.load())
    for t in texts():
        assert own.count(t) == (len(model.tokenize(vocabulary.normalise(t))) if t else 0), t


def test_unknown_runs_and_ties_without_bytes():
    v = vocabulary.Vocabulary([None, ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("xy", -3.0)], 0, None)
    own = tokencount.Counter(v)
    assert own.chunk("ab") == 1  # -2 either way: the piece that starts first wins
    assert own.chunk("a??b") == 3 and own.chunk("x") == 1 and own.chunk("xy") == 1 and own.chunk("?x?") == 1


def test_queries(spark, sf, library):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    model = unigram()
    for r in QUERIES["op8_sentencepiece"](spark, sf).collect():
        ids = library.encode(docs[r.doc_id] or "")
        text = (docs[r.doc_id] or "").replace("▁", " ").encode()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest() and r.round_trip
    got = QUERIES["op10_token_counts"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_tokens == (len(model.tokenize(vocabulary.normalise(docs[r.doc_id]))) if docs[r.doc_id] else 0)


def test_edges_in_frames(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)] + [(None, "a"), (2, "a")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    ids = pieces.encode(df, ["doc_id"])
    back = {r.doc_id: r.text for r in pieces.decode(ids, ["doc_id"]).collect() if r.doc_id is not None}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(EDGES)}
    assert pieces.encode(df.limit(0), ["doc_id"]).count() == tokencount.count_tokens(df.limit(0), ["doc_id"]).count() == 0
    assert tokencount.count_tokens(df, ["doc_id"]).filter("doc_id < 2").agg(F.sum("n_tokens")).first()[0] == 0


def test_portions_are_bounded_by_bytes():
    column = pa.array(["ab", None, "", "x" * 50, "y", "z" * 9, "ü" * 4] * 3)
    parts = list(portions(column, rows=4, limit=10))
    assert [t for p in parts for t in p.to_pylist()] == column.to_pylist()
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 10) for p in parts)
    assert [p.to_pylist() for p in portions(column.slice(3, 2), limit=10)] == [["x" * 50], ["y"]] and list(portions(column.slice(0, 0))) == []

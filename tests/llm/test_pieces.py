import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weftline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "hello  world ", "  a\tb\nc", "①ﬁ é é 日本語 🙂 \x00z <s> </s> <unk> <0x41> ▁x▁▁y", "   ", "a" * 700, "ab" * 500 + " " + "the" * 400, "x  " * 50, "\n\n  \n", "▁", "don't  stop", "ÿ\xad​ end"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_op4_equals_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, None), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, pieces.round_trip(docs, PATH).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    want = []
    for doc, text in rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), sum(library.is_byte(i) for i in ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def test_decode_equals_the_library(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "doc_id long, text string")
    got = dict(map(tuple, pieces.decode(pieces.encode(docs, PATH), PATH).collect()))
    assert got == {**{i: library.decode(library.encode(t)) for i, t in enumerate(ODD)}, 99: ""}
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count() == 0


def test_edges_are_all_occurrences():
    v = pieces.Vocabulary(PATH)
    data = "▁the▁there".encode() + b"\xff" + "ab\x00c".encode()
    keys, piece = pieces.edges(v, data)
    want = sorted((i * 64 + len(p), k) for k, p in enumerate(v.pieces) for i in range(len(data)) if data.startswith(p, i))
    assert list(zip(keys.tolist(), piece.tolist())) == want

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ppm
from weftline.llm.text import crc_fold, in_fold, lower_words


def brute(rows):
    """base and PPM scores, by dictionaries of contexts that reach over token starts."""
    train = [lower_words(t) + [b""] for i, t in rows if i is not None and crc_fold(i, 5) != 1]
    counts = Counter(w for d in train for w in d)
    coded = lambda tokens: b" " * 5 + b"".join(w + b" " for w in tokens)
    trie = defaultdict(Counter)
    for s in map(coded, train):
        for i in range(5, len(s)):
            for k in range(6):
                trie[s[i - k : i]][s[i]] += 1
    n, v = sum(counts.values()), len(counts)

    def symbol(context, x):
        out, excluded = 0.0, set()
        for k in range(5, -1, -1):
            node = {s: c for s, c in trie.get(context[5 - k :], {}).items()}
            left = {s: c for s, c in node.items() if s not in excluded}
            if x in left:
                return out + math.log10(left[x] / (sum(left.values()) + len(left)))
            if left:
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
            excluded |= set(node)
        return out - math.log10(256 - len(excluded))

    for i, t in rows:
        tokens = lower_words(t) + [b""]
        s = coded(tokens)
        score = sum(symbol(s[j - 5 : j], s[j]) for j in range(5, len(s)))
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        yield i, i is not None and crc_fold(i, 5) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def run(docs):
    held = in_fold(F.col("id"), 5, 1)
    out = ppm.scores(docs, ~held & F.col("id").isNotNull())
    return out.select("id", ~F.col("learned") & F.col("id").isNotNull(), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()


def test_op9_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "GROUP_BYTES", 20_000)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Zz zz \x00 é 日本 zzzzzzzzzz"), (None, "null id"), (7, "same row"), (7, "same row"), (10**6 + 3, "long " * 5000)]
    close(run(spark.createDataFrame(rows, "doc_id long, text string").withColumn("grp", F.lit("clash"))), brute(rows))


def test_op9_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run(empty) == []
    held = [i for i in range(60) if crc_fold(i, 5) == 1][:4]
    rows = [(i, "nothing to learn") for i in held]
    close(run(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows))


def test_the_model_predicts_held_out_text_better_than_byte_frequencies(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    coded = {r.doc_id: b"".join(w + b" " for w in [*lower_words(r.text), b""]) for r in rows}
    held = {i for i in coded if crc_fold(i, 5) == 1}
    counts = Counter(b for i, data in coded.items() if i not in held for b in data)
    total = sum(counts.values())
    zero = sum(math.log10((counts[b] + 0.5) / (total + 128)) for i in held for b in coded[i])
    out = ppm.op9_ppm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score")).first()
    assert out[0] > 0.8 * zero


def test_probabilities_of_a_context_add_up_to_one():
    code = np.concatenate([ppm.codes_of(b" " * 5 + w + b" ") for w in (b"aba", b"abb", b"ba", b"abab")])
    every = np.unique(np.concatenate([(c & ~0xFF) | np.arange(256) for c in code] + [((0x7A7A7A0000 + 0x6162) << 8) | np.arange(256)]))
    u, n = ppm._sums(code, np.ones(len(code)))
    low, two = (ppm._sums(code & m, np.ones(len(code))) for m in (0xFFFF, 0xFFFFFF))
    p = np.exp(ppm.log_probabilities(every, ppm._at(u, n, every), low, two))
    _, total = ppm._sums(every >> 8, p)
    assert total == pytest.approx(np.ones(len(total)))


def test_op9_order_of_words_counts_and_hot_ids_are_shared_out(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ppm, "GROUP_BYTES", 3_000)
    monkeypatch.setattr(ppm, "BUCKET", 500)
    rows = [(i, f"a rose is a rose {i} times") for i in range(40)] + [(None, f"no id {i} here") for i in range(60)] + [(7, f"one id {i} on many rows") for i in range(60)]
    rows += [(2**62, "far away"), (-(2**63), "least id"), (10**6 + 4, "a rose is a rose"), (10**6 + 5, "rose a a is rose"), (3, "same row"), (3, "same row")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ppm.op9_ppm(spark, str(tmp_path)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    close(got, brute(rows))
    by_id = {g[0]: g[6] for g in got}
    assert abs(by_id[10**6 + 4] - by_id[10**6 + 5]) > 0.1
    grouped, n = ppm._grouped(spark.createDataFrame(rows, "id long, text string"))
    counts = [r[1] for r in grouped.groupBy("grp").count().collect()]
    assert 2 * n >= len(counts) > 4 and max(counts) < 70 and sum(counts) == len(rows)


def test_slices_keep_their_contexts():
    streams = [b"", b"ab", b"abcdefgh ijklmnop " * 5, b"xyz"]
    whole = [ppm.codes_of(b" " * 5 + s) for s in streams]
    for size in (1, 3, 7, 1000):
        parts = list(ppm.sliced(enumerate(streams), size))
        assert [c for p in parts for c in p.symbols()] == [c for w in whole for c in w]
        total = np.zeros(len(streams), np.int64)
        for p in parts:
            np.add.at(total, p.owners, p.sums(p.codes & 0xFFFF))
        assert total.tolist() == [int((w & 0xFFFF).sum()) for w in whole]
    assert whole[1].tolist() == [0x202020202061, 0x202020206162]


def test_codes_find_values_through_collisions():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 48, 5000))
    table = ppm.Codes(codes[::2].copy(), np.arange(len(codes[::2]), dtype=float))
    value, found = table[codes]
    assert found.tolist() == [i % 2 == 0 for i in range(len(codes))] and (value[::2] == np.arange(len(codes[::2]))).all()

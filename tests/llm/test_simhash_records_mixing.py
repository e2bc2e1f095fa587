import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import mixing, records, simhash

DOCS = "doc_id long, text string, source string"


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_links_connect_like_brute_force():
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([centers, *(centers ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)), np.arange(64, dtype=np.uint64)]))
    bucket = np.sort(rng.integers(0, 3, len(codes)))
    order = np.lexsort((simhash.gray_rank(codes), bucket))
    bucket, codes = bucket[order], codes[order]
    want = [(i, j) for i in range(len(codes)) for j in range(i) if bucket[i] == bucket[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 3]
    forest = simhash.Forest(len(codes))
    forest.add(*np.array(want).T)
    assert np.array_equal(simhash.linked(bucket, codes), forest.label)
    assert forest.label.tolist() == brute_components(list(range(len(codes))), [int(c) ^ int(b) << 100 ^ (int(b) * 0xFFFF << 110) for c, b in zip(codes, bucket)])


def test_op5_dense_bucket_stays_small():
    """16,384 fingerprints alike on all but 14 bits: 3.8 million links, in bounded memory."""
    import tracemalloc

    codes = np.arange(1 << 14, dtype=np.uint64) << np.uint64(20)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    tracemalloc.start()
    assert (simhash.linked(np.zeros(len(codes), np.int64), codes) == 0).all()
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_gray_rank_inverts_gray_code():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(2**54 // 1000 * 37)
    assert np.array_equal(simhash.gray_rank(x ^ (x >> np.uint64(1))), x)


def test_op5_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(90001, None), (90002, ""), (90003, "One two"), (90003, "One two"), (None, rows[0][1]), (90004, "  x Ünï é\x0b y z w " * 3000)]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip((i for i, _ in rows), fps, brute_components([i for i, _ in rows], fps)))
    assert Counter((r.id, r.fp % 2**64, r.component_id) for r in got) == want


def test_op5_large_buckets_are_dealt_again_and_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    base[:20] = (base[:20] & np.uint64(0xFFFFFFFF)) | np.uint64(0xABCDEF0100000000)  # alike on two blocks
    flips = [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(8)]
    codes = [int(x) for x in np.unique(np.concatenate(flips))]
    edges = simhash.fingerprint_links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in codes], "fp long"), split=100).collect()
    place = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(codes)}
    forest = simhash.Forest(len(codes))
    forest.add(np.array([place[r.u] for r in edges]), np.array([place[r.v] for r in edges]))
    assert forest.label.tolist() == brute_components(list(range(len(codes))), codes)


def test_op5_finer_masks_share_out_the_bits_left():
    for mask in (0, 0xFFFF, 2**64 - 8, 2**64 - 1):
        more = simhash.finer(mask)
        assert len(more) == 4 and all(m & mask == mask for m in more)
        assert sum((m ^ mask).bit_count() for m in more) == 64 - mask.bit_count()
        assert more[0] | more[1] | more[2] | more[3] == 2**64 - 1


def test_op5_empty_and_long_chain(spark):
    assert simhash.classes(spark.createDataFrame([], DOCS)).count() == 0
    from weftline.llm.components import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(1, 201), 0), 1001: 1000}


def test_op10_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    odd = ["", None, " ", "  a  b\n\n c \t d ", "<|endoftext|> x <|endoftext|>", "a  b  c 'll don't", "🙂 é́ \x1c z", "x" * 5000, "a \n b"]
    odd += ["word " * 50_000 + "end\nline of a very long text " * 3000]
    rows = rows[:150] + [(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "null id"), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).repartition(3)
    out = records.fresh_path(spark, "records")
    files = records.write_records(docs, path, out)
    got = records.read_records(spark, out, files).orderBy("start").collect()
    signed = lambda h: h - (h >> 63 << 64)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else signed(xxhash.xxh64_intdigest(r[1], 42))))
    start = 0
    assert len(got) == len(rows)
    for g, (doc, text) in zip(got, rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(g) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (doc, text[:50] if text else text)
        start += len(ids)
    empty = records.fresh_path(spark, "records")
    assert records.read_records(spark, empty, records.write_records(docs.limit(0), path, empty)).count() == 0


def test_op10_one_id_fills_several_files_and_reads_by_bytes(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(records, "READ", 100)
    monkeypatch.setattr(records, "CACHE", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in (F.concat(F.lit("text "), F.col("id")), F.lit("one text")):
        docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), text.alias("text")).repartition(6)
        out = records.fresh_path(spark, "records")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        files = records.write_records(docs, path, out)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(files) > 2 and max(n for _, n, _ in files) < 3000
        got = records.read_records(spark, out, files).orderBy("start").collect()
        assert len(got) == 4000 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_op10_generations_of_pieces_keep_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(records, "CACHE", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc, rng = Tokenizer.from_file(path), records.Encoder(path), random.Random(2)
    words = [f"w{i}{end}" for i in range(60) for end in ("", ".", ",\nnext", "\t", "\n\nx")]
    words += [f"{w}{end}" for w in ("été", "straße", "the", "Ünï", "日本", "ǆǅ", "don't", "x²", "'s") for end in ("", ".", "$$$", ",;", "!!\nthe...", "...\n", "'", ".x", "%\n%")] + ["...", "$", "\n.", "a\tb."]
    for _ in range(12):
        texts = [" ".join(rng.choices(words, k=12)) for _ in range(20)]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_detect_damage():
    data = bytearray(records.frame(b"abc") + records.frame(b""))
    assert records.unframe(bytes(data), 0) == (b"abc", 19)
    assert records.unframe(bytes(data), 19) == (b"", 35)
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            p = records.unframe(bytes(bad), 0)
            records.unframe(bytes(bad), p[1])


def test_knapsack_and_fit_are_exact_on_small_cases():
    rng = random.Random(1)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        sums = {0}
        for a, b in zip(lengths, counts):
            sums = {s + k * a for s in sums for k in range(b + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert all(t <= c for t, c in zip(take, counts))
        assert sum(a * t for a, t in zip(lengths, take)) == max(s for s in sums if s <= budget)
    lengths = np.array([0, 3, 7, 50, 20000])
    counts = np.array([5, 100000, 1000, 400, 30])
    take = mixing.fit(lengths, counts, 777_777)
    assert (take <= counts).all() and take[0] == 0 and lengths @ take == 777_777


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 10], [1, 2, 3], 30) == [5.0, 10.0, 15.0]
    got = mixing.targets([100, 100, 1], [1, 2, 3], 201)
    assert got[2] == 3.0 and got[0] == pytest.approx(66.0) and got[1] == pytest.approx(132.0)
    assert mixing.targets([0, 0], [1, 2], 0) == [0.0, 0.0]


def test_op2_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(10**6, None, None), (10**6 + 1, "", "src0"), (10**6 + 2, "a b c", None), (None, "q r", "src1"), (5, "dup", "src1"), (5, "dup", "src1")]
    rows += [(2 * 10**6 + i, "same text here", "src2") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size = {t: len((t or "").encode().split()) for _, t, _ in rows}
    assert Counter((r.id, r.source, r["size"]) for r in got) == Counter((i, s, size[t]) for i, t, s in rows)
    taken, total, of, goal = Counter(), Counter(), {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        total[r.source] += r["size"]
        of[r.source], goal[r.source] = r.source_size, r.target
    assert of == total
    names = sorted(total, key=lambda s: (s is None, s or ""))
    assert [goal[s] for s in names] == pytest.approx(mixing.targets([total[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(total.values())))
    for s in names:
        assert abs(taken[s] - goal[s]) <= 2, s
    assert mixing.mix(docs.limit(0)).count() == 0

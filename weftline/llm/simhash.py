"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints at 3 or fewer differing bits agree on one of four 16-bit blocks at
least, so each distinct fingerprint goes to the four buckets of its blocks. Large
buckets are dealt again by blocks of the bits left, by the same rule. In a
bucket the fingerprints are sorted by Gray rank and grouped, group by group, into
a tree whose nodes hold the bits that all members share. The self-join walks pairs
of nodes: differences accumulate over the bits newly shared at each level, a pair
is pruned once they exceed the limit, and taken as a whole once all open bits fit
within it. Links are joined into a forest as the walk finds them, CHUNK pairs of nodes
at a time, so a task never holds all pairs of a bucket, however alike its members are.

Null and empty texts have fingerprint zero and link like any other; texts are read
whole, however long. A bit set in exactly half of the hashes is 0. A null id takes no
part in the least id of a component (null if it has no other). One row per input row,
repeated rows included; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.text import in_parts, lower_words
from weftline.sources.shared import written

LIMIT = 3
BLOCKS = LIMIT + 1
#: Fingerprints of a bucket that one task holds.
SPLIT = 1 << 17
FAN = 8
#: Pairs of nodes that are opened at a time, each into FAN * FAN pairs at most.
CHUNK = 1 << 13


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of all word shingles."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): a hash of the text, and the fingerprint as a long with its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in in_parts(batch)):
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["id", "key", "fp"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("key"))
    return src.mapInArrow(run, "id long, key long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order: the binary number whose Gray code it is."""
    x = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Forest:
    """Components of nodes 0..n-1 under links that are added bit by bit; label: least node of each node's component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        a, b = lab[a], lab[b]
        while (open_ := a != b).any():
            a, b = a[open_], b[open_]
            low = np.minimum(a, b)
            np.minimum.at(lab, a, low)
            np.minimum.at(lab, b, low)
            while not np.array_equal(nxt := lab[lab], lab):
                lab[:] = nxt
            a, b = lab[a], lab[b]


class Level:
    """Nodes over consecutive members of the level below; first has one more entry than there are nodes."""

    def __init__(self, first: np.ndarray, all_and: np.ndarray, all_or: np.ndarray):
        self.first, self.all_and, self.all_or = first, all_and, all_or
        self.mask = ~(all_and ^ all_or)


def _tree(bucket: np.ndarray, codes: np.ndarray) -> list[Level]:
    """Levels from the codes up to one root a bucket; both arrays sorted by bucket and Gray rank."""
    levels = [Level(np.arange(len(codes) + 1), codes, codes)]
    owner = bucket
    while True:
        below = levels[-1]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        if len(starts) == len(owner) and len(levels) > 1:
            return levels
        within = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        heads = np.flatnonzero(within % FAN == 0)
        levels.append(Level(np.append(heads, len(owner)), np.bitwise_and.reduceat(below.all_and, heads), np.bitwise_or.reduceat(below.all_or, heads)))
        owner = owner[heads]


def _first_leaf(levels: list[Level], k: int, nodes: np.ndarray) -> np.ndarray:
    for level in range(k, 0, -1):
        nodes = levels[level].first[nodes]
    return nodes


def linked(bucket: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each code the least position of those in its bucket that are within limit, directly or through others."""
    forest = Forest(len(codes))
    if not len(codes):
        return forest.label
    levels = _tree(bucket, codes)
    top, roots = len(levels) - 1, np.arange(len(levels[-1].mask))
    stack = [(top, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.uint64))]
    while stack:
        k, a, b, acc, seen = stack.pop()
        if len(a) > CHUNK:
            stack += [(k, a[i : i + CHUNK], b[i : i + CHUNK], acc[i : i + CHUNK], seen[i : i + CHUNK]) for i in range(0, len(a), CHUNK)]
            continue
        level = levels[k]
        shared = level.mask[a] & level.mask[b]
        acc = acc + np.bitwise_count((level.all_and[a] ^ level.all_and[b]) & shared & ~seen)
        whole = acc + np.bitwise_count(~shared) <= limit
        if whole.any():
            x, y = a[whole], b[whole]
            same = x == y
            forest.add(_first_leaf(levels, k, x[~same]), _first_leaf(levels, k, y[~same]))
            if k and same.any():
                lo, hi = _first_leaf(levels, k, x[same]), _first_leaf(levels, k, x[same] + 1)
                forest.add(np.repeat(lo, hi - lo), np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange((hi - lo).sum()))
        more = ~whole & (acc <= limit)
        if not k or not more.any():
            continue
        a, b, acc, shared = a[more], b[more], acc[more], shared[more]
        na, nb = np.diff(level.first)[a], np.diff(level.first)[b]
        pair = np.repeat(np.arange(len(a)), na * nb)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = level.first[a][pair] + at // nb[pair], level.first[b][pair] + at % nb[pair]
        up = x <= y
        stack.append((k - 1, x[up], y[up], acc[pair[up]], shared[pair[up]]))
    return forest.label


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) sorted by bucket come in; a spanning forest of each bucket's links goes out."""
    keys, codes = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def joined(keys, codes):
        order = np.lexsort((gray_rank(codes), keys))
        keys, codes = keys[order], codes[order]
        lab = linked(keys, codes)
        own = np.flatnonzero(lab != np.arange(len(lab)))
        return pa.RecordBatch.from_arrays([pa.array(codes[own].view(np.int64)), pa.array(codes[lab[own]].view(np.int64))], ["u", "v"])

    for b in batches:
        keys = np.concatenate((keys, b.column(0).to_numpy()))
        codes = np.concatenate((codes, b.column(1).to_numpy().view(np.uint64)))
        cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if cut >= 1 << 14:
            yield joined(keys[:cut], codes[:cut])
            keys, codes = keys[cut:], codes[cut:]
    yield joined(keys, codes)


def finer(mask: int) -> list[int]:
    """Masks that add one of BLOCKS parts of the other bits each: fingerprints linked and alike on mask are alike on one of them."""
    free = np.array([i for i in range(64) if not mask >> i & 1], np.int64)
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(free, BLOCKS)]


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint_links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """Edges (u, v) whose components are those of all links among the distinct fingerprints in column fp.

    A bucket holds the fingerprints alike on a mask's bits. Buckets of more than
    split fingerprints are dealt again by masks with more bits, so no task holds
    a larger one; after a few rounds too few bits are left to differ for that.
    """
    spark = fps.sparkSession
    masks, open_, parts = [0], fps.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    while True:
        of = {m: finer(m) for m in masks}
        deal = F.create_map(*(x for m, more in of.items() for x in (F.lit(_long(m)), F.array(*(F.lit(_long(k)) for k in more)))))
        dealt = open_.select(F.explode(F.element_at(deal, F.col("mask"))).alias("mask"), "fp")
        dealt = dealt.withColumn("bucket", F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))))
        large = dealt.groupBy("bucket", F.col("mask").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split)
        large = written(spark, large.select(F.col("bucket").alias("large"), "of"), "large")
        masks = sorted(r.of % (1 << 64) for r in large.select("of").distinct().collect())  # four at first, four times as many a round at most
        if not masks:
            parts.append(dealt.select("bucket", "fp"))
            break
        marked = dealt.join(large, (F.col("bucket") == F.col("large")) & (F.col("mask") == F.col("of")), "left")
        parts.append(marked.where("large IS NULL").select("bucket", "fp"))
        open_ = written(spark, marked.where("large IS NOT NULL").select("mask", "fp"), "open")
    buckets = reduce(DataFrame.union, parts).repartition("bucket").sortWithinPartitions("bucket")
    return buckets.mapInArrow(_bucket_links, "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp, root, component_id) for every row of docs: key is a hash of the text, root a fingerprint that
    stands for the component, component_id its least id."""
    spark = docs.sparkSession
    of_doc = written(spark, fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(spark, of_doc.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(spark, fingerprint_links(fps))
    linked = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = linked.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return of_doc.join(named, F.col("fp") == F.col("f")).select("id", "key", "fp", "root", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

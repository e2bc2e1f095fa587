"""Language-model scores by prediction by partial matching over bytes, beside a smoothed unigram base.

Text is lower-cased words, then one end. The model codes each token's bytes and a
closing space, each byte from the ORDER bytes before it in the document, across
tokens (spaces before the document's start). Counts of all contexts come from the
whole training part.
A context escapes with as much weight as it has distinct symbols; symbols that it
held are excluded from the shorter contexts below it; below order 0 all bytes
left are alike. Code lengths add up to the log probability of the text.

Nothing that grows with the corpus goes through the driver or one task, but one
number for each GROUP_BYTES of text at most. Documents are dealt to groups of
about that size: ranges of ids, and shares by hash of the text where a range is
larger (null ids are such a range). Tasks count the distinct words and n-grams
(context and symbol as one integer) of each group as they read its texts, SLICE
bytes at a time. The distinct n-grams of all groups meet in buckets by hash of the
last three context bytes, with the order-2 rows below them; the tables of orders 0
and 1 have at most 65,536 rows and travel with the tasks. Log probabilities and
word counts go back to the groups that asked for them, packed; a task holds one
group's, while the texts stream past.

A null text is empty (the end only). Null ids are never part of the training.
Repeated rows each count and each get a score. Texts are read whole, however long.
With nothing to learn from, tokens score 0 in the base and bytes are uniform. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.text import in_fold, in_parts, lower_words
from weftline.sources.shared import written

ORDER = 5
#: Bytes of a group, about, and how many times that a range of ids may hold before it is shared out.
GROUP_BYTES, LARGE = 64 << 20, 2
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
#: Bytes that are coded at a time, and n-grams beside a group's distinct ones that a task holds at least before it adds them up.
SLICE, MERGE = 1 << 20, 500_000
#: Distinct n-grams that a task holds before it hands them on, and rows that it packs at a time.
FLUSH_CODES, PACKED = 2_000_000, 200_000
#: Counted n-grams for each bucket of contexts.
BUCKET = 100_000
_PAD = b" " * ORDER


def codes_of(padded: bytes) -> np.ndarray:
    """Codes (ORDER context bytes and the symbol) of all bytes after the first ORDER."""
    windows = np.ndarray((len(padded) - ORDER,), ">u8", padded + b"\0\0", 0, (1,))
    return (windows >> np.uint64(16)).view(np.int64)


class Slice:
    """Codes of parts (ORDER bytes of context, then symbols) side by side; those of a part stand from first to last."""

    def __init__(self, parts: list[bytes], owners: list[int]):
        at = np.cumsum([0, *map(len, parts)])
        self.codes, self.first, self.last, self.owners = codes_of(b"".join(parts)), at[:-1], at[1:] - ORDER, np.array(owners, np.int64)

    def symbols(self) -> np.ndarray:
        """Codes without those whose symbol is context of the next part."""
        keep = np.ones(len(self.codes), bool)
        keep[(self.last[:-1, None] + np.arange(ORDER)).ravel()] = False
        return self.codes[keep]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values (one a code) of each part."""
        return np.add.reduceat(values, np.column_stack((self.first, self.last)).ravel()[:-1])[::2]


def sliced(streams: Iterable[tuple[int, bytes]], size: int | None = None) -> Iterator[Slice]:
    """Slices of (owner, stream), about size bytes each; a longer stream is cut, with its context kept."""
    size = size or SLICE
    parts, owners, held = [], [], 0
    for owner, s in streams:
        s = _PAD + s
        for at in range(0, len(s) - ORDER, size):
            parts.append(s[at : at + size + ORDER])
            owners.append(owner)
            held += len(parts[-1])
            if held >= size:
                yield Slice(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        yield Slice(parts, owners)


def stream(tokens: list[bytes]) -> bytes:
    """The bytes of a document: each token and a closing space."""
    return b" ".join(tokens) + b" "


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n of each."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(n[order], heads) if len(heads) else n[:0]


def _at(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """values at these keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(want))
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[i] == want, values[i], 0.0)


def log_probabilities(codes: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural log probability of the symbol of each code after its context.

    codes: distinct, all that share their last three context bytes (or all there
    are); n: training counts, 0 where only scored. low, two: sorted keys and counts
    of orders 1 and 2; those of order 2 are all of the contexts in codes at least.
    """
    seen = n > 0
    table = {}
    for k in range(ORDER, 2, -1):
        table[k] = _sums(codes[seen] & ((1 << 8 * (k + 1)) - 1), n[seen])
    table[2], table[1] = two, low
    table[0] = _sums(low[0] & 0xFF, low[1])
    total, kinds, shared = {}, {}, {}
    for k in range(ORDER, -1, -1):
        keys, c = table[k]
        total[k], kinds[k] = _sums(keys >> 8, c), _sums(keys >> 8, np.ones(len(keys)))
        if k:
            below = keys & ((1 << 8 * k) - 1)
            shared[k] = _sums(keys >> 8, _at(*table[k - 1], below))
    out, done = np.zeros(len(codes)), np.zeros(len(codes), bool)
    above = np.zeros(len(codes), bool)
    gone, excluded = np.zeros(len(codes)), np.zeros(len(codes))
    for k in range(ORDER, -1, -1):
        key = codes & ((1 << 8 * (k + 1)) - 1)
        context = key >> 8
        t, d, c = _at(*total[k], context), _at(*kinds[k], context), _at(*table[k], key)
        here = t > 0
        left, new = t - np.where(above, gone, 0), d - np.where(above, excluded, 0)
        hit, escape = here & ~done & (c > 0), here & ~done & (c == 0) & (new > 0)
        out[hit] += np.log(c[hit] / (left[hit] + new[hit]))
        out[escape] += np.log(new[escape] / (left[escape] + new[escape]))
        done |= hit
        if k:
            gone, excluded, above = _at(*shared[k], context), d, here
        else:
            excluded = np.where(here, d, 0)
    out[~done] -= np.log(256 - excluded[~done])
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return parts[0] if len(parts) == 1 else _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, word, code, n) from (grp, learn, text): training counts of words (code null) and n-grams (word null)."""
    held: dict[int, Counter] = {}
    waiting: dict[tuple[int, bool], list[bytes]] = defaultdict(list)
    codes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def code_waiting():
        for (grp, learn), some in waiting.items():
            own = codes[grp]
            for part in sliced((0, s) for s in some):
                u, n = np.unique(part.symbols(), return_counts=True)
                own.append((u, n if learn else np.zeros(len(u), np.int64)))
                if sum(len(u) for u, _ in own[1:]) > max(MERGE, len(own[0][0])):
                    own[:] = [_added(own)]
        waiting.clear()

    def flush_codes():
        code_waiting()
        for grp, own in codes.items():
            code, total = _added(own)
            for i in range(0, len(code), 1 << 18):
                u = code[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), grp)), pa.nulls(len(u), pa.binary()), pa.array(u), pa.array(total[i : i + len(u)])], ["grp", "word", "code", "n"])
        codes.clear()

    def flush():
        for grp, counts in held.items():
            words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            for i in range(0, len(words), 1 << 16):
                w = words[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), grp)), pa.array(w, pa.binary()), pa.nulls(len(w), pa.int64()), pa.array(n[i : i + len(w)])], ["grp", "word", "code", "n"])
        held.clear()

    seen = size = 0
    for b in (part for batch in batches for part in in_parts(batch, 2)):
        for grp, learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = lower_words(text)
            words.append(b"")
            counts = held.setdefault(grp, Counter())
            if learn:
                counts.update(words)
            else:
                for w in words:
                    counts.setdefault(w, 0)
            waiting[grp, learn].append(stream(words))
            seen += len(words)
            size += len(text or "")
        if size > SLICE:
            size = 0
            code_waiting()
            if sum(len(u) for own in codes.values() for u, _ in own) > FLUSH_CODES:
                yield from flush_codes()
        if seen > FLUSH // 4:  # looked at now and then: distinct words are fewer than words
            seen = 0
            if sum(map(len, held.values())) > FLUSH:
                yield from flush()
    yield from flush()
    yield from flush_codes()


def _grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (id, text and more) with the group of each row in grp, and about how many there are. Neighbours in id tend
    to be neighbours in the files, so groups are ranges of ids; one that holds far too much is shared out by hash of the text."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 64
    lo, hi, total = docs.agg(F.min("id"), F.max("id"), F.coalesce(F.sum(size), F.lit(0))).first()
    cells = total // GROUP_BYTES + 1
    width = ((hi - lo) // cells + 1) if lo is not None else 1
    cell = F.coalesce(F.expr(f"CAST((CAST(id AS DECIMAL(20,0)) - {lo or 0}) DIV {width} AS BIGINT)"), F.lit(-1).cast("long"))
    docs = docs.withColumn("grp", cell)
    shared = F.ceil(F.sum(size) / GROUP_BYTES).cast("long")
    large = docs.groupBy(F.col("grp").alias("of")).agg(shared.alias("shares")).where(f"shares > {LARGE}").collect()  # fewer than one for each GROUP_BYTES of text
    if large:
        more = F.broadcast(docs.sparkSession.createDataFrame(large, "of long, shares long"))
        share = F.pmod(F.xxhash64("text"), F.coalesce("shares", F.lit(1).cast("long")))
        docs = docs.join(more, F.col("grp") == F.col("of"), "left").withColumn("grp", F.col("grp") + (cells + 1) * share).drop("of", "shares")
    return docs, cells + sum(r.shares for r in large)


def _packed(rows: DataFrame) -> DataFrame:
    """(grp, keys, values): the keys and values of (grp, key, value) rows, many a row. Keys are words (joined by spaces) or numbers."""
    words = rows.schema["key"].dataType.typeName() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def emit():
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            order = np.argsort(t.column(0).to_numpy(), kind="stable")
            t = t.take(pa.array(order))
            grp, keys, values = t.column(0).to_numpy(), t.column(1), t.column(2).to_numpy()
            heads = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])).tolist() if len(grp) else []
            spans = list(zip(heads, [*heads[1:], len(grp)], strict=True))
            blobs = [b" ".join(keys.slice(i, j - i).to_pylist()) if words else keys.slice(i, j - i).to_numpy().tobytes() for i, j in spans]
            yield pa.RecordBatch.from_arrays([pa.array(grp[heads]), pa.array(blobs, pa.binary()), pa.array([values[i:j].tobytes() for i, j in spans], pa.binary())], ["grp", "keys", "values"])

        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) > PACKED:
                yield from emit()
        if waiting:
            yield from emit()

    return rows.select("grp", "key", "value").mapInArrow(run, "grp long, keys binary, values binary")


class _Once(dict):
    """Counts of words; those that are left out count 1."""

    def __missing__(self, word):
        return 1


class Codes:
    """Values at sorted codes: a table by hash, and binary search for what it has lost to collisions."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.shift = np.uint64(64 - max(8, 2 + len(codes).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(self.codes)] = np.arange(len(codes))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __getitem__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether there is one."""
        if not len(self.codes):
            return np.zeros(len(codes)), np.zeros(len(codes), bool)
        at = self.table[self._slot(codes)]
        lost = np.flatnonzero(self.codes[at] != codes)
        at[lost] = np.minimum(np.searchsorted(self.codes, codes[lost]), len(self.codes) - 1)
        found = np.ones(len(codes), bool)
        found[lost] = self.codes[at[lost]] == codes[lost]
        return self.values[at], found


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, kind, id, learn, text, keys, values) by grp and kind: n-grams (0) and words (1) of a group, then its documents (2)."""
    grp, code_parts, known, codes = None, [], _Once(), None

    def scores(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [lower_words(t) + [b""] for t in b.column(4).to_pylist()]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        c = np.fromiter((known[w] for t in tokens for w in t), np.int64, int(sizes.sum()))
        heads = np.cumsum(sizes) - sizes
        score = np.zeros(len(tokens))
        for part in sliced((i, stream(t)) for i, t in enumerate(tokens)):
            value, found = codes[part.codes]
            score += np.bincount(part.owners, weights=part.sums(value), minlength=len(score))
            if part.sums((~found).astype(np.int64)).any():
                raise RuntimeError("an n-gram of a group was not counted with it")
        columns = [sizes, np.add.reduceat((c > 0).astype(np.int64), heads), np.add.reduceat(np.log10(c + 0.5), heads), score / np.log(10)]
        return pa.RecordBatch.from_arrays([b.column(2), b.column(3), *map(pa.array, columns)], ["id", "learned", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        own, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
            if i == j:
                continue
            b = batch.slice(i, j - i)
            if own[i] != grp:
                grp, code_parts, known, codes = own[i], [], _Once(), None
            if kind[i] == 0:
                code_parts += [(np.frombuffer(k, np.int64), np.frombuffer(v)) for k, v in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
            elif kind[i] == 1:
                for k, v in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                    known.update(zip(k.split(b" "), np.frombuffer(v, np.int64).tolist(), strict=True))
            else:
                if codes is None:
                    codes = Codes(*(np.concatenate(x) for x in zip(*code_parts, strict=True))) if code_parts else Codes(np.zeros(0, np.int64), np.zeros(0))
                    code_parts = []
                for part in in_parts(b, 4):
                    yield scores(part)


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score); learn (over column id) marks the training rows."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    grouped, groups = _grouped(src.withColumn("learn", learn))
    parts = written(spark, grouped.select("grp", "learn", "text").mapInArrow(_counted, "grp long, word binary, code long, n long"), "parts")
    words, codes = parts.where("word IS NOT NULL"), parts.where("code IS NOT NULL")

    word_counts = written(spark, words.groupBy("word").agg(F.sum("n").alias("value")), "words")
    tokens, distinct = word_counts.agg(F.coalesce(F.sum("value"), F.lit(0)), F.count_if(F.col("value") > 0)).first()
    counts = written(spark, codes.groupBy("code").agg(F.sum("n").alias("n")), "codes")
    trained = counts.where("n > 0")
    rows = trained.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("k")).agg(F.sum("n").alias("n")).collect()  # two bytes: 65,536 at most
    rows.sort()
    low = (np.array([r.k for r in rows], np.int64), np.array([r.n for r in rows], float))

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        code, k = left.column("code").to_numpy(), right.column("k").to_numpy()
        order = np.argsort(k)
        two = (k[order], right.column("n").to_numpy()[order].astype(float))
        return pa.table({"code": code, "lp": log_probabilities(code, left.column("n").to_numpy().astype(float), low, two)})

    buckets = counts.count() // BUCKET + 1
    bucket = F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(buckets)).alias("bucket")
    pair = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair")
    two = trained.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("k")).agg(F.sum("n").alias("n"))
    two = two.join(counts.select(bucket, pair).distinct(), F.shiftright("k", 8) == F.col("pair")).select("bucket", "k", "n")
    lp = counts.select(bucket, "code", "n").groupBy("bucket").cogroup(two.groupBy("bucket")).applyInArrow(evaluate, "code long, lp double")

    # What each group holds learns its value: a join by word or n-gram, whose hot keys adaptive execution splits.
    code_rows = codes.select("grp", F.col("code").alias("key")).repartition("key").distinct().join(lp.select(F.col("code").alias("key"), F.col("lp").alias("value")), "key")
    word_rows = words.select("grp", F.col("word").alias("key")).repartition("key").distinct().join(word_counts.where("value <> 1").select(F.col("word").alias("key"), "value"), "key")
    table = [t.select("grp", F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("learn"), F.lit(None).cast("string").alias("text"), "keys", "values") for kind, t in enumerate((_packed(code_rows), _packed(word_rows)))]
    texts = grouped.select("grp", F.lit(2).alias("kind"), "id", "learn", "text", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("values"))
    dealt = table[0].union(table[1]).union(texts).repartition(max(1, 3 * groups), "grp").sortWithinPartitions("grp", "kind")
    out = dealt.mapInArrow(_scored, "id long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    floor = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return out.withColumn("base_score", F.col("base_score") - F.col("n_tokens") * F.lit(floor)).withColumn("train_tokens", F.lit(int(tokens)).cast("long"))


def op9_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = in_fold(F.col("id"), 5, 1)
    out = scores(docs, ~held & F.col("id").isNotNull())
    return out.select(F.col("id").alias("doc_id"), (~F.col("learned") & F.col("id").isNotNull()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's logit is the sum of weights of its hashed byte n-grams; a document is
toxic if any sentence is, by noisy-or. Weights are fitted to document labels
through the noisy-or, so the sentences that carry the label are found without
sentence labels. Only the text is an input.

Null and empty texts have one empty sentence and score by the bias alone. Labels
that are null are left out; documents with several labels count as toxic if any
is 1, and of several texts of one labelled id the one with the least hash is
learned. Without labels of both kinds every score is 0. Repeated rows score alike.
Texts are scored whole, however long; to learn from, one with more than FIT_BYTES is
not drawn. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.text import LOWER, in_fold, in_parts, least_hashes

SIZES = (5, 7)
BITS = 18
#: Bounds of the training sample, and of the n-grams that get a weight.
TOXIC_DOCS, OTHER_DOCS, FEATURES = 3000, 5000, 4096
#: Bytes of texts of either label that the driver holds to fit.
FIT_BYTES = 24 << 20
THRESHOLD = 0.7
#: Documents whose n-grams are held at once while fitting.
FITTED_AT_ONCE = 128
_PIECE = 1 << 22


def _byte_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the sentence of each byte, and the document of each sentence. Every text ends in a stop of its own."""
    joined = b"".join((t or "").encode().translate(LOWER) + b"\n" for t in texts)
    data = np.frombuffer(joined, np.uint8)
    stop = np.isin(data, np.frombuffer(b".!?\n", np.uint8))
    ends = np.cumsum([len((t or "").encode()) + 1 for t in texts])
    sentence = np.cumsum(stop) - stop
    return data, sentence, np.searchsorted(ends, np.flatnonzero(stop), side="right")


def _grams(data: np.ndarray, sentence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams within sentences, and the sentence of each."""
    if len(data) < n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + data[k : k + len(h)]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = sentence[: len(h)] == sentence[n - 1 :]
    return (h >> np.uint32(32 - BITS))[inside], sentence[: len(h)][inside]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, weights: dict[int, np.ndarray], bias: float, at: float):
        """at: the document logit that counts as THRESHOLD."""
        self.weights, self.bias, self.at = weights, bias, at

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit and document of each sentence, and the bytes before each sentence's end."""
        data, sentence, owner = _byte_runs(texts)
        z = np.full(len(owner), self.bias)
        for n in SIZES:
            for i in range(0, len(data), _PIECE):
                h, s = _grams(data[i : i + _PIECE + n - 1], sentence[i : i + _PIECE + n - 1], n)
                w = self.weights[n][h]
                some = np.flatnonzero(w)
                z += np.bincount(s[some], weights=w[some], minlength=len(z)) if len(some) else 0
        return z, owner, np.flatnonzero(np.isin(data, np.frombuffer(b".!?\n", np.uint8)))

    def scores(self, z: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
        clean = np.bincount(owner, weights=np.logaddexp(0, np.clip(z, -500, 500)), minlength=docs)
        logit = np.where(clean > 30, clean, np.log(np.expm1(np.clip(clean, 1e-300, 30)) + 1e-300))
        return sigmoid(logit - self.at + np.log(THRESHOLD / (1 - THRESHOLD)))


def fit(texts: list[str | None], y: np.ndarray, steps: int = 150, rate: float = 0.15) -> Model:
    """Keep the FEATURES n-grams whose document counts differ most between labels, then descend on the noisy-or loss."""
    n_docs = len(texts)
    pos, neg = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    toxic, other = ({n: np.zeros(1 << BITS) for n in SIZES} for _ in range(2))
    for i in range(0, n_docs, FITTED_AT_ONCE):
        data, sentence, owner = _byte_runs(texts[i : i + FITTED_AT_ONCE])
        for n in SIZES:
            h, s = _grams(data, sentence, n)
            pair = np.unique(owner[s].astype(np.int64) << BITS | h)
            label, gram = y[i + (pair >> BITS)], pair & ((1 << BITS) - 1)
            toxic[n] += np.bincount(gram, weights=label, minlength=1 << BITS)
            other[n] += np.bincount(gram, weights=1 - label, minlength=1 << BITS)
    kept, index, total = {}, {}, 0
    for n in SIZES:
        a, b = toxic[n], other[n]
        gain = (a / pos - b / neg) / np.sqrt((a + b + 4) * (1 / pos**2 + 1 / neg**2) / 2)
        kept[n] = np.argsort(-np.abs(np.where(a + b >= 5, gain, 0)), kind="stable")[: FEATURES // len(SIZES)]
        index[n] = np.full(1 << BITS, -1, np.int32)
        index[n][kept[n]] = np.arange(len(kept[n])) + total
        total += len(kept[n])
    rows, cols, owners, n_sent = [], [], [], 0
    for i in range(0, n_docs, FITTED_AT_ONCE):
        data, sentence, owner = _byte_runs(texts[i : i + FITTED_AT_ONCE])
        for n in SIZES:
            h, s = _grams(data, sentence, n)
            at = index[n][h]
            rows.append((s[at >= 0] + n_sent).astype(np.int32))
            cols.append(at[at >= 0])
        owners.append(owner + i)
        n_sent += len(owner)
    row, col, owner = np.concatenate(rows), np.concatenate(cols), np.concatenate(owners)
    del rows, cols, owners
    w, bias = np.zeros(total), -4.0
    m, v, mb, vb = np.zeros(total), np.zeros(total), 0.0, 0.0
    each = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=n_sent) + bias
        p = sigmoid(z)
        clean = np.exp(-np.bincount(owner, weights=np.logaddexp(0, z), minlength=n_docs))
        dirty = np.maximum(1 - clean, 1e-9)
        d = (np.where(y == 1, -clean / dirty, 1.0) * each)[owner] * p
        g, gb = np.bincount(col, weights=d[row], minlength=total) + 2e-5 * w, d.sum()
        m, mb, v, vb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb, 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (vb / (1 - 0.99**step) + 1e-16) ** 0.5
    weights, first = {}, 0
    for n, top in kept.items():
        weights[n] = np.zeros(1 << BITS, np.float32)
        weights[n][top] = w[first : first + len(top)]
        first += len(top)
    return Model(weights, float(bias), 0.0)


def calibrated(model: Model, texts: list[str | None], y: np.ndarray) -> Model:
    """Place the threshold where documents that were not fitted are told apart best (F1; the middle of the widest best gap)."""
    parts = []
    for i in range(0, len(texts), FITTED_AT_ONCE):
        part = texts[i : i + FITTED_AT_ONCE]
        z, owner, _ = model.sentences(part)
        parts.append(model.scores(z, owner, len(part)))
    s = np.concatenate(parts)
    logit = np.log(np.clip(s, 1e-12, 1)) - np.log(np.clip(1 - s, 1e-12, 1)) - np.log(THRESHOLD / (1 - THRESHOLD))
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    upper = logit[order[best]]
    lower = logit[order[best + 1]] if best + 1 < len(order) else upper - 1
    model.at = float((upper + max(lower, upper - 6)) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 42) -> Model | None:
    """Fit on a bounded sample of the labelled documents given: TOXIC_DOCS and OTHER_DOCS by least hash, FIT_BYTES of either
    at most; a fourth of it places the threshold."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("k")).agg(F.max(label_col).alias("y"))
    known = known.withColumn("h", F.xxhash64("k", F.lit(seed)))
    sample = least_hashes(known.where("y = 1"), TOXIC_DOCS).union(least_hashes(known.where("y = 0"), OTHER_DOCS))
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    src = src.withColumn("key", F.xxhash64("text")).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))))
    # At most TOXIC_DOCS + OTHER_DOCS ids are broadcast, and the sizes of their texts collected before any text is.
    drawn = src.join(F.broadcast(sample), F.col("id") == F.col("k")).groupBy("id", "h", "y").agg(F.min(F.struct("key", "size")).alias("t")).select("id", "h", "y", "t.*").collect()
    left, some = {0: FIT_BYTES, 1: FIT_BYTES}, []
    for r in sorted(drawn, key=lambda r: (r.h, r.id)):
        if r.size <= left[int(r.y)]:
            left[int(r.y)] -= r.size
            some.append((r.id, r.key, r.h, int(r.y)))
    wanted = docs.sparkSession.createDataFrame(some, "k long, key_ long, h long, y int")
    rows = src.join(F.broadcast(wanted), (F.col("id") == F.col("k")) & (F.col("key") == F.col("key_"))).groupBy("id", "h", "y").agg(F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.h, r.id))
    y = np.array([r.y for r in rows], float)
    if not y.sum() or not (1 - y).sum():
        return None
    texts, held = [r.text for r in rows], np.array([i % 4 == 0 for i in range(len(rows))])
    part = lambda keep: ([t for t, k in zip(texts, keep, strict=True) if k], y[keep])
    if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
        held = np.ones(len(y), bool)
        return calibrated(fit(texts, y), texts, y)
    return calibrated(fit(*part(~held)), *part(held))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """(id, score, sentences): sentences holds start:end (code points) of each sentence scored at least offending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in in_parts(batch)):
            texts = b.column(1).to_pylist()
            if model is None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0.0] * len(texts)), pa.array([""] * len(texts))], ["id", "score", "sentences"])
                continue
            scores, where = [], []
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                z, owner, stops = model.sentences(part)
                scores.append(model.scores(z, owner, len(part)))
                found: list[list[str]] = [[] for _ in part]
                raw = None
                for s in np.flatnonzero(z >= np.log(offending / (1 - offending))):
                    if raw is None:
                        raw = [(t or "").encode() for t in part]
                        base = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
                    d = owner[s]
                    begin = max(0, (stops[s - 1] + 1 if s else 0) - base[d])
                    end = min(len(raw[d]), stops[s] + 1 - base[d])
                    first = len(raw[d][:begin].decode("utf-8", "ignore"))
                    found[d].append(f"{first}:{first + len(raw[d][begin:end].decode('utf-8', 'ignore'))}")
                where += [",".join(f) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([*scores, np.zeros(0)])), pa.array(where, pa.string())], ["id", "score", "sentences"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "id long, score double, sentences string")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.where(~in_fold(F.col("doc_id"), 3, 1)))
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")

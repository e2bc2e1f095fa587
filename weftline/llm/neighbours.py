"""Approximate nearest neighbours by inner product, with an adaptive dimension scan of probed lists.

Vectors get one more component, so that the largest inner product is the least
distance: sqrt(M^2 - |x|^2) for rows and 0 for queries, with M the longest row. A
k-means on a bounded sample gives lists; every row is in its nearest list. A scan
turns vectors by one random rotation and adds up squared differences column block
by column block; after each block a hypothesis test drops the pairs whose partial
distance is too large for the query's current k-th best. What survives is ranked
by the inner product of the original vectors, in double precision.

Each query first scans its nearest list, which gives its k-th best so far; then
its further lists. How many is the least that finds RECALL of the true neighbours
of PROBE_QUERIES queries, whose neighbours are searched in all rows; those that find
all of theirs in the nearest list do not weigh in. A query whose lists hold too few
candidates goes on to as many further lists as it takes for k rows, in the end to all.

Long lists are cut into pieces of ROWS_A_PIECE rows, and their queries into pieces
too; no task holds more than a piece of each. Equal vectors (a third of all rows,
say) so spread over tasks. What the driver holds is the sample, the lists' centres
and sizes, and the probe queries.

Null vectors, zero ones and those with null or non-finite components take no part,
nor do null ids and vectors of another length than most. Rows of the query's own
id are no candidates. Query rows alike in id and vector are one query; those of one
id with several vectors are as many queries, each with its own ranks. Among the
candidates every row counts, repeated ones too. Ties go to the smaller id. An empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.llm.text import least_hashes
from weftline.sources.shared import written

#: Lists grow with the square root of the rows. The sample has ROWS_A_LIST rows for each, SAMPLE at least; MOST_LISTS are
#: reached at a billion rows and bound what the driver holds (half a million sampled vectors).
SAMPLE, MOST_LISTS, ROWS_A_LIST = 20_000, 1 << 15, 16
PROBE_QUERIES, RECALL = 192, 0.97
ROWS_A_PIECE, QUERIES_A_PIECE = 4096, 8192
BLOCK, QUERY_BLOCK, ROW_BLOCK = 16, 256, 1024
#: Width of the hypothesis test: pairs are dropped beyond (1 + EPSILON / sqrt(columns seen)) times the expected share.
EPSILON = 2.1
_SLACK = 1e-5


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lengthened(x: np.ndarray, longest: float | None) -> np.ndarray:
    """One more component; 0 where longest is None (queries)."""
    x = x.astype(np.float64)
    rest = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return np.column_stack((x, rest))


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        d = (centres * centres).sum(1) - 2 * x[i : i + 4096] @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, qid: np.ndarray, xid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the k nearest: rotated vectors in column blocks, dropped early.

    Rows of the query's own id are left out. bound: squared distance of each query's k-th best so far; it falls as rows are scanned.
    """
    dim, out_q, out_x = q.shape[1], [], []
    bound = bound.copy()
    best = np.full((len(q), k), np.inf, np.float32)
    for i in range(0, len(x), ROW_BLOCK):
        part = x[i : i + ROW_BLOCK]
        seen = min(BLOCK, dim)
        a, b = q[:, :seen], part[:, :seen]
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        pq, px = np.nonzero(d <= (bound * (seen / dim) * (1 + EPSILON / seen**0.5) ** 2)[:, None])
        other = qid[pq] != xid[i + px]
        pq, px = pq[other], px[other]
        far = d[pq, px]
        while seen < dim and len(pq):
            nxt = min(seen + BLOCK, dim)
            diff = q[pq, seen:nxt] - part[px, seen:nxt]
            far = far + np.einsum("ij,ij->i", diff, diff)
            seen = nxt
            test = 1.0 if seen == dim else (seen / dim) * (1 + EPSILON / seen**0.5) ** 2
            stay = far <= bound[pq] * test
            pq, px, far = pq[stay], px[stay], far[stay]
        out_q.append(pq)
        out_x.append(px + i)
        if len(pq):
            # The k-th best of each query falls with what this block has left.
            order = np.lexsort((far, pq))
            sq, sf = pq[order], far[order]
            rank = np.arange(len(sq)) - np.searchsorted(sq, sq)
            top = rank < k
            new = np.full((len(q), k), np.inf, np.float32)
            new[sq[top], rank[top]] = sf[top]
            best = np.sort(np.concatenate((best, new), axis=1), axis=1)[:, :k]
            bound = np.minimum(bound, best[:, -1] * (1 + _SLACK) + _SLACK)
    return np.concatenate(out_q), np.concatenate(out_x)


def top_of(qid: np.ndarray, xid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to smaller ids."""
    order = np.lexsort((xid, -score, qid))
    own = qid[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def list_count(rows: int) -> int:
    return min(MOST_LISTS, round(rows**0.5))


class Index:
    """Centres and rotation; small, and sent to the tasks with their code."""

    def __init__(self, sample: np.ndarray, longest: float, rows: int, seed: int):
        self.dim, self.longest = sample.shape[1], longest
        x = lengthened(sample, longest)
        lists = max(1, min(len(x) // ROWS_A_LIST, list_count(rows)))
        self.centres = k_means(x, lists, seed)
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.dim + 1, self.dim + 1)))[0]

    def turned(self, x: np.ndarray, rows: bool) -> np.ndarray:
        return (lengthened(x, self.longest if rows else None) @ self.rotation).astype(np.float32)

    def search(self, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
        """left: rows (vec_id, v); right: queries (n: their numbers, query_id, q, bound: least score wanted, or null)."""
        x, q = matrix(left.column("v"), self.dim), matrix(right.column("q"), self.dim)
        xid, qid, number = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy(), right.column("n").to_numpy()
        least = right.column("bound").to_numpy().astype(float)
        out = []
        if len(x) and len(q):
            tx = self.turned(x, True)
            for i in range(0, len(q), QUERY_BLOCK):
                part = q[i : i + QUERY_BLOCK].astype(np.float64)
                length = (part * part).sum(1)
                least_part = least[i : i + QUERY_BLOCK]
                limit = np.where(np.isnan(least_part), np.inf, (length + self.longest**2 - 2 * least_part) * (1 + _SLACK) + _SLACK)
                a, b = scan(self.turned(part, False), tx, limit.astype(np.float32), k, qid[i : i + QUERY_BLOCK], xid)
                score = np.einsum("ij,ij->i", part[a], x[b].astype(np.float64))
                keep = top_of(number[i + a], xid[b], score, k)
                a, b = i + a[keep], b[keep]
                out.append((number[a], qid[a], xid[b], score[keep]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        return pa.table({"n": cols[0].astype(np.int64), "query_id": cols[1].astype(np.int64), "vec_id": cols[2].astype(np.int64), "score": cols[3]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where is_query (over column vec_id)."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return empty
    dim, n, longest = lengths[0].d, lengths[0].n, float(lengths[0].m) ** 0.5
    rows = rows.where(F.size("v") == dim)
    sample = least_hashes(rows.select("v", F.xxhash64("vec_id", F.lit(seed)).alias("h")), max(SAMPLE, ROWS_A_LIST * list_count(n)), n=n).select("v").toArrow()
    index = Index(matrix(sample.column("v"), dim), longest, n, seed)

    def assign(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(lengthened(x, index.longest), index.centres, 1)[:, 0])], ["vec_id", "v", "list"])

    listed = written(spark, rows.mapInArrow(assign, f"vec_id long, v array<{dict(vectors.dtypes)[vector_col][6:-1]}>, list long"), "listed")
    queries = listed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    queries = written(spark, queries.select(F.monotonically_increasing_id().alias("n"), "query_id", "q", F.xxhash64("query_id", F.lit(seed + 1)).alias("h")), "queries")

    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MOST_LISTS rows
    rows_of = np.zeros(len(index.centres), np.int64)
    for r in sizes:
        rows_of[r["list"]] = r["n"]
    own_rows = listed.where(is_query).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def probes(first: int, last: int):
        """Lists from first on, up to last, or beyond it until they hold k candidates (not for the nearest alone)."""

        def run(batches):
            for b in batches:
                q = matrix(b.column(2), dim)
                at = nearest(lengthened(q, None), index.centres, max(2, len(rows_of)))
                enough = (np.cumsum(rows_of[at], axis=1) < k + own_rows).sum(1) + 1
                stop = np.maximum(last, enough) if first else np.full(len(q), last)
                place = np.arange(at.shape[1])[None]
                use = (place >= first) & (place < stop[:, None]) & (rows_of[at] > 0)
                take = pa.array(np.repeat(np.arange(len(q)), use.sum(1)))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(4)), pa.array(at[use].astype(np.int64))], ["n", "query_id", "q", "bound", "list"])

        return run

    query_type = dict(listed.dtypes)["v"]

    def scanned(asked: DataFrame) -> DataFrame:
        """The k best of each query in the lists it asks for."""
        many = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(r["list"], -(-r["n"] // ROWS_A_PIECE), -(-many[r["list"]] // QUERIES_A_PIECE)) for r in sizes if r["list"] in many]
        pieces = F.broadcast(spark.createDataFrame(plan, "list long, xs long, qs long"))
        left = listed.join(pieces, "list").select("list", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), "xs").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)).alias("y"))
        right = asked.join(pieces, "list").select("list", "n", "query_id", "q", "bound", F.pmod(F.xxhash64("n"), "qs").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)).alias("x"))
        both = left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y"))
        return both.applyInArrow(lambda a, b: index.search(a, b, k), "n long, query_id long, vec_id long, score double")

    # How many lists to probe: all rows against a bounded set of queries.
    probe = least_hashes(queries, PROBE_QUERIES).select("n", "query_id", "q").toArrow()
    if not probe.num_rows:
        return empty
    pq, pid, pn = matrix(probe.column("q"), dim).astype(np.float64), probe.column("query_id").to_numpy(), probe.column("n").to_numpy()

    def brute(batches):
        for b in batches:
            x, xid, own = matrix(b.column(1), dim).astype(np.float64), b.column(0).to_numpy(), b.column(2).to_numpy()
            s = pq @ x.T
            s[pid[:, None] == xid[None]] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
            a = np.repeat(np.arange(len(pid)), top.shape[1])
            good = np.isfinite(s[a, top.ravel()])
            a, t = a[good], top.ravel()[good]
            yield pa.RecordBatch.from_arrays([pa.array(pn[a]), pa.array(xid[t]), pa.array(s[a, t]), pa.array(own[t])], ["n", "vec_id", "score", "list"])

    true = _ranked(listed.mapInArrow(brute, "n long, vec_id long, score double, list long"), k).select("n", "list").collect()
    order = nearest(lengthened(pq, None), index.centres, max(2, len(index.centres)))
    place = {(int(i), int(c)): r for i, row in zip(pn, order, strict=True) for r, c in enumerate(row)}
    of: dict[int, list[int]] = {}
    for r in true:
        of.setdefault(r.n, []).append(place[r.n, r["list"]])
    # Queries that need no further list (hot equal vectors, say) would only lower the number for the others.
    ranks = np.sort([x for own in of.values() if max(own) for x in own])
    lists = int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1 if len(ranks) else 1

    schema = f"n long, query_id long, q {query_type}, bound double, list long"
    asked = queries.select("n", "query_id", "q", F.lit(None).cast("double").alias("bound"))
    first = written(spark, scanned(asked.mapInArrow(probes(0, 1), schema)), "first")
    bounds = _ranked(first, k).where(F.col("rank") == k).select(F.col("n").alias("b"), F.col("score").alias("bound"))
    more = queries.join(bounds, F.col("n") == F.col("b"), "left").select("n", "query_id", "q", "bound")
    found = first.union(scanned(written(spark, more.mapInArrow(probes(1, lists), schema), "asked")))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)

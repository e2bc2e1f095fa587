"""SentencePiece encoding and decoding by suffix-array matching.

The distinct pieces of text of a batch (a run of spaces and what follows) are
concatenated and all suffixes sorted; every vocabulary piece is found by binary
search as a range of suffixes, which gives the edges (position, length, score) of
the batch. Edges are sorted by position, and a relaxation then joins neighbouring
symbols over the best-scored edge that spans them, in all texts at once, until
none spans two symbols. That is what a BPE model means: a path of least total
cost over the same edges gives other ids, so the relaxation follows merges.
Characters without a piece become their bytes.

A null text is empty and has no ids. White space is kept, U+2581 counts as a space
and so decodes to one. Texts are encoded whole, repeated rows alike; an empty
table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.text import in_parts

SPACE = "▁"
#: Pieces of text kept by a worker, and symbols up to which texts are relaxed side by side.
CACHE, LONG = 200_000, 256
#: Bytes of pieces whose suffixes are sorted together (a longer piece is sorted alone).
SORTED = 1 << 18
_SEPARATOR = b"\xff"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        self.text = [b""] * n
        found = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif not special[i]:
                found.append((name.encode(), i, model.get_score(i)))
                self.text[i] = name.replace(SPACE, " ").encode()
        # Texts are cut before spaces, which holds only if no piece has one after another character.
        if any(SPACE in p.decode().lstrip(SPACE) for p, _, _ in found):
            raise ValueError(f"{path}: a piece crosses a space")
        found.sort()
        self.pieces = [p for p, _, _ in found]
        self.ids = np.array([i for _, i, _ in found], np.int64)
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.longest = int(self.sizes.max())
        # Least is best: order of score, then of id.
        self.rank = np.empty(len(found), np.int64)
        self.rank[np.lexsort((self.ids, [-s for _, _, s in found]))] = np.arange(len(found))
        self.low = np.array(self.pieces, f"S{self.longest}")
        self.high = np.array([p.ljust(self.longest, _SEPARATOR) for p in self.pieces], f"S{self.longest}")


def edges(vocabulary: Vocabulary, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (position, length) of all occurrences of pieces in data, and the piece of each."""
    width = vocabulary.longest
    padded = np.frombuffer(data + _SEPARATOR * width, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(data)]
    suffixes = np.ascontiguousarray(rows).view(f"S{width}").ravel()
    order = np.argsort(suffixes, kind="stable")
    ordered = suffixes[order]
    first, last = np.searchsorted(ordered, vocabulary.low, "left"), np.searchsorted(ordered, vocabulary.high, "right")
    n = np.maximum(last - first, 0)
    piece = np.repeat(np.arange(len(n)), n)
    at = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(piece))]
    key = at.astype(np.int64) * 64 + vocabulary.sizes[piece]
    by_place = np.argsort(key, kind="stable")
    return key[by_place], piece[by_place]


def _merged_long(vocabulary: Vocabulary, keys: np.ndarray, piece: np.ndarray, ends: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Spans of one long text, by a heap of candidate joins."""
    bounds = [start, *ends.tolist()]
    n = len(bounds) - 1
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), bounds[1:]
    begin, alive = bounds[:-1], [True] * n
    table = dict(zip(keys.tolist(), piece.tolist(), strict=True))

    def push(i: int) -> None:
        j = right[i]
        if j < n and (p := table.get(begin[i] * 64 + end[j] - begin[i])) is not None and end[j] - begin[i] < 64:
            heapq.heappush(heap, (int(vocabulary.rank[p]), i, end[i], end[j]))

    heap: list = []
    for i in range(n):
        push(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if not alive[i] or j >= n or end[i] != middle or end[j] != stop:
            continue
        end[i], right[i], alive[j] = stop, right[j], False
        if right[j] < n:
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [(begin[i], end[i]) for i in range(n) if alive[i]]


def relax(vocabulary: Vocabulary, texts: list[bytes]) -> list[bytes]:
    """Ids of each text (with escaped spaces) as bytes of vocabulary.kind."""
    if not texts:
        return []
    data = b"".join(t + _SEPARATOR for t in texts)
    keys, piece = edges(vocabulary, data)
    raw = np.frombuffer(data, np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.flatnonzero(((raw & 0xC0) != 0x80) & (raw != 0xFF))
    owner = np.searchsorted(stops, starts)
    ends = np.append(starts[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ends[last] = stops[owner[last]]
    count = np.bincount(owner, minlength=len(texts))
    none = len(vocabulary.rank)

    def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that spans a..b, none where there isn't one."""
        want = a * 64 + (b - a)
        i = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        hit = (b - a < 64) & (keys[i] == want) if len(keys) else np.zeros(len(a), bool)
        return np.where(hit, vocabulary.rank[piece[i]] if len(keys) else none, none)

    done_s, done_e = [], []
    for t in np.flatnonzero(count > LONG):
        mine = owner == t
        lo, hi = np.searchsorted(keys, [starts[mine][0] * 64, (int(stops[t]) + 1) * 64])
        spans = np.array(_merged_long(vocabulary, keys[lo:hi], piece[lo:hi], ends[mine], int(starts[mine][0])), np.int64)
        done_s.append(spans[:, 0])
        done_e.append(spans[:, 1])
    some = count[owner] <= LONG
    s, e, o = starts[some], ends[some], owner[some]
    r = np.full(len(s), none)
    pairs = np.flatnonzero(o[1:] == o[:-1])
    r[pairs] = find(s[pairs], e[pairs + 1])
    while len(s):
        heads = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        best = np.minimum.reduceat(r, heads)
        sizes = np.diff(np.append(heads, len(s)))
        open_ = best < none
        if not open_.all():
            rest = np.repeat(open_, sizes)
            done_s.append(s[~rest])
            done_e.append(e[~rest])
            s, e, o, r = s[rest], e[rest], o[rest], r[rest]
            best, sizes = best[open_], sizes[open_]
            if not len(s):
                break
            heads = np.cumsum(sizes) - sizes
        hits = np.flatnonzero(r == np.repeat(best, sizes))
        at = hits[np.append(True, o[hits[1:]] != o[hits[:-1]])]  # the leftmost of each text
        e[at] = e[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        s, e, o, r = s[keep], e[keep], o[keep], r[keep]
        for again in (at, at[at > 0] - 1):
            paired = again[again + 1 < len(s)]
            r[again] = none
            paired = paired[o[paired] == o[paired + 1]]
            r[paired] = find(s[paired], e[paired + 1])
    s, e = np.concatenate([*done_s, np.zeros(0, np.int64)]), np.concatenate([*done_e, np.zeros(0, np.int64)])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    rank = find(s, e)
    id_of_rank = np.empty(none + 1, np.int64)
    id_of_rank[vocabulary.rank] = vocabulary.ids
    known = rank < none
    width = np.where(known, 1, e - s)
    ids = np.repeat(id_of_rank[np.where(known, rank, 0)], width)
    spot = np.repeat(s - np.cumsum(width) + width, width) + np.arange(len(ids))
    ids = np.where(np.repeat(known, width), ids, vocabulary.byte_ids[raw[np.minimum(spot, len(raw) - 1)]])
    per_text = np.bincount(np.searchsorted(stops, s), weights=width, minlength=len(texts)).astype(np.int64)
    out, cuts = ids.astype(vocabulary.kind).tobytes(), np.append(0, np.cumsum(per_text)) * vocabulary.kind.itemsize
    return [out[a:b] for a, b in zip(cuts.tolist(), cuts.tolist()[1:], strict=False)]


def _groups(pieces: list[str]) -> Iterator[list[str]]:
    """The pieces in order, in lists of about SORTED bytes."""
    out, size = [], 0
    for p in pieces:
        n = len(p.encode())
        if out and size + n > SORTED:
            yield out
            out, size = [], 0
        out.append(p)
        size += n
    if out:
        yield out


class Codec:
    """Encodes each distinct piece of text once. Pieces never cross a space that follows another character."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes | None] = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 512):
            part = texts[i : i + 512]
            parts = [t.replace(SPACE, " ").split(" ") for t in part]
            if len(self.known) > CACHE:
                self.known.clear()
            new = [p for p in set().union(*parts) if p not in self.known]
            whole = [p for p in new if p]
            self.known[""] = None
            for some in _groups(whole):
                self.known.update(zip(some, relax(self.vocabulary, [(SPACE + p).encode() for p in some]), strict=True))
            for text, p in zip(part, parts, strict=True):
                try:
                    data = b"".join(map(self.known.__getitem__, p))
                except TypeError:
                    data = self._spaced(p) if text else b""
                yield np.frombuffer(data, self.vocabulary.kind)

    def _spaced(self, parts: list[str]) -> bytes:
        """Runs of spaces: an empty part adds one to the run before the next word."""
        chunks, run = [], 0
        for p in parts:
            run += 1
            if p:
                chunks.append(SPACE * run + p)
                run = 0
        chunks += [SPACE * run] if run else []
        plain = [self.known[c[1:]] if c[1] != SPACE else None for c in chunks if len(c) > 1] if all(len(c) > 1 for c in chunks) else None
        if plain is not None and None not in plain:
            return b"".join(plain)
        return b"".join(relax(self.vocabulary, [c.encode() for c in chunks]))

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.vocabulary.text.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, restored) for every row of docs: restored tells whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in (part for batch in batches for part in in_parts(batch)):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = list(c.encode(texts))
            same = [c.decode(x) == t.replace(SPACE, " ") for t, x in zip(texts, ids, strict=True)]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, c.vocabulary.kind)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(same, pa.bool_())], ["id", "ids", "restored"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>, restored boolean")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    src = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return src.mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_bytes, ids_crc32, restored): ids that stand for single bytes, a checksum of
    the ids as little-endian unsigned 32-bit integers, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        single = np.zeros(len(c.vocabulary.text), bool)
        single[c.vocabulary.byte_ids] = True
        for b in (part for batch in batches for part in in_parts(batch)):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, m, crc, same = [], [], [], []
            for t, ids in zip(texts, c.encode(texts), strict=True):
                n.append(len(ids))
                m.append(int(single[ids].sum()))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                same.append(c.decode(ids) == t.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, m, crc)), pa.array(same, pa.bool_())], ["id", "n_tokens", "n_bytes", "ids_crc32", "restored"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "id long, n_tokens long, n_bytes long, ids_crc32 long, restored boolean")


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).select(F.col("id").alias("doc_id"), "n_tokens", "n_bytes", "ids_crc32", "restored")

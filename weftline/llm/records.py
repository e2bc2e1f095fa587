"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of records: length (u64), masked checksum of the length
(u32), payload, masked checksum of the payload (u32). A payload is a flag byte,
the document's id (i64, 0 where the flag says null) and its token ids, 2 bytes
each where the vocabulary allows, else 4 (the low flag bits tell the width). The
index beside it holds (offset, id, tokens) of each record, for shuffled reads.
Files follow the order of ids, and file names that of files.

A null text is empty: only the end id is written. A null id sorts first. Rows
that repeat stay; ties of one id are ordered by the texts' 64-bit hashes, and their
rows may fill several files. Texts are encoded whole, however long, one record
each. An empty table writes no record and reads back empty.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.text import in_parts
from weftline.sources.shared import fresh_path

END_ID = 2
MASK_DELTA = 0xA282EAD8
NULL_ID = 0x10
INDEX = np.dtype([("offset", "<u8"), ("id", "<i8"), ("tokens", "<u4"), ("null", "u1")])
#: Pieces of the newer of two generations that a worker keeps, and pieces encoded as one text.
CACHE, JOINED = 800_000, 1000
#: Texts whose pieces are learned together.
TOGETHER = 1024
#: Marks that close words. Letters up to this one are letters to every version of Unicode.
_MARKS, _LETTERS = ".,;:!?$%*#", "\u024f"
#: Bytes of records read at once (one record at least).
READ = 8 << 20


def masked(data: bytes) -> int:
    """A checksum that stays sound over data which holds checksums itself."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview | bytes, at: int) -> tuple[bytes, int]:
    """The payload at this offset and the next record's offset; ValueError where a checksum differs."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(head):
        raise ValueError(f"broken length at {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12 : end])
    if len(data) < end + 4 or struct.unpack("<I", data[end : end + 4])[0] != masked(payload):
        raise ValueError(f"broken payload at {at}")
    return payload, end + 4


class Encoder:
    """Token ids of texts, as bytes of one integer type.

    A byte-level pre-tokenizer always starts a token at a single space between
    two other characters, and a single line end between two such is a token of its
    own; texts are cut at both and each distinct piece is encoded once, many at a
    time. It also parts letters from marks, so marks that close a word are put to its
    ids. Texts with wider white space at a cut are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.newline = self.tokenizer.token_to_id("\u010a")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.heads: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes | None] = {}
        self.older: tuple[dict, dict] = {}, {}

    def _joined(self, pieces: list[str], mark: str, starts) -> list[bytes]:
        """Ids of each piece: many are encoded as one text, cut again where ids begin a piece. starts: ids to flags."""
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([mark + mark.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(starts(ids))
            if len(cuts) != len(group):
                raise RuntimeError("pieces and cuts differ")
            data, at = ids.tobytes(), [*(cuts * ids.itemsize).tolist(), ids.nbytes]
            drop = 0 if mark == " " else ids.itemsize
            out += [data[x + drop : y] for x, y in zip(at, at[1:], strict=False)]
        return out

    def _learn(self, tails: set[str], heads: set[str]) -> None:
        """Fill both caches. Pieces with single line ends inside are put together from the lines' ids.

        When the caches are full they become the older generation, and what is seen again moves back from it.
        """
        if len(self.tails) + len(self.heads) > CACHE:
            self.older, self.tails, self.heads = (self.tails, self.heads), {}, {}
        compound: dict[str, list[str]] = {}
        simple: dict[str, set[str]] = {" ": set(), "": set()}
        closed: list[tuple[dict, str, str, str]] = []
        for mark, pieces, cache, older in ((" ", tails, self.tails, self.older[0]), ("", heads, self.heads, self.older[1])):
            new = pieces.difference(cache)
            again = set(filter(older.__contains__, new))  # an intersection would walk all that is kept
            cache.update(zip(again, map(older.__getitem__, again), strict=True))
            for p in new - again:
                if p.isalpha():
                    simple[mark].add(p)
                    continue
                if p.split() == [p]:
                    word = p.rstrip(_MARKS)
                    if len(word) == len(p) or not word.isalpha() or not (word.isascii() or max(word) <= _LETTERS):
                        simple[mark].add(p)
                        continue
                    closed.append((cache, p, word, p[len(word) :]))
                    if word in older:
                        cache[word] = older[word]
                    elif word not in cache:
                        simple[mark].add(word)
                    simple[""].add(p[len(word) :])
                    continue
                lines = p.split("\n")
                if not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                    cache[p] = None
                    continue
                if len(lines) > 1:
                    compound.setdefault(mark, []).append(p)
                    simple[""].update(x for x in lines[1:] if x not in self.heads)
                if lines[0] not in cache:
                    simple[mark].add(lines[0])
        # A line may have been seen as a head after it was put on the list.
        simple[""].difference_update(self.heads)
        for mark, cache, flag in ((" ", self.tails, lambda ids: self.spaced[ids]), ("", self.heads, lambda ids: ids == self.newline)):
            todo = list(simple[mark])
            cache.update(zip(todo, self._joined(todo, mark or "\n", flag), strict=True))
        for cache, p, word, marks in closed:
            cache[p] = cache[word] + self.heads[marks]
        end = np.array([self.newline], self.dtype).tobytes()
        for mark, pieces in compound.items():
            cache = self.tails if mark else self.heads
            for p in pieces:
                first, *rest = p.split("\n")
                cache[p] = end.join([cache[first], *(self.heads[x] for x in rest)])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), TOGETHER):
            some = texts[i : i + TOGETHER]
            tails = [t.split(" ") for t in some]
            heads = [p.pop(0) for p in tails]
            self._learn(set().union(*tails), set(heads))
            for text, head, tail in zip(some, heads, tails, strict=True):
                try:
                    yield b"".join((self.heads[head], *map(self.tails.__getitem__, tail)))
                except TypeError:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Encode and write all rows in order of id; (file, records, tokens) of each file, in that order.

    Rows are dealt by ranges of id (and, within one id, of the text's hash and then of
    the rows' places) before they are encoded, so texts move once and each task streams
    its range into one file. A task writes under a name of its
    attempt and renames, so repeated attempts leave the same file. What comes back
    to the driver is one row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, store = encoder(tokenizer_path), None
        end = np.array([end_id], enc.dtype).tobytes()
        width = np.dtype(enc.dtype).itemsize
        task = TaskContext.get()
        name, offset, index = f"part-{task.partitionId():08d}", 0, []
        for b in (part for batch in batches for part in in_parts(batch)):
            if store is None:
                store, at = fs.FileSystem.from_uri(out)
                store.create_dir(at, recursive=True)
                temp = f"{at}/_{name}-{task.taskAttemptId()}"
                data = store.open_output_stream(f"{temp}.rec")
            texts = [x or "" for x in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(texts), strict=True):
                payload = struct.pack("<Bq", width | (NULL_ID if doc is None else 0), doc or 0) + ids + end
                index.append((offset, doc or 0, (len(ids) + width) // width, doc is None))
                offset += data.write(frame(payload))
        if store is None:
            return
        data.close()
        rows = np.array(index, INDEX)
        with store.open_output_stream(f"{temp}.idx") as f:
            f.write(rows.tobytes())
        for kind in ("idx", "rec"):
            store.move(f"{temp}.{kind}", f"{at}/{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([int(rows["tokens"].sum(dtype=np.int64))], pa.int64())], ["file", "records", "tokens"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    placed = src.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    dealt = placed.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "text").select("id", "text")
    return sorted(map(tuple, dealt.mapInArrow(run, "file string, records long, tokens long").collect()))


def read_records(spark: SparkSession, out: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, read from the files with all checksums verified."""
    start, rows = 0, []
    for name, _, tokens in files:
        rows.append((name, start))
        start += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(out)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{at}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with store.open_input_file(f"{at}/{name}.rec") as f:
                    ends, i = np.append(index["offset"][1:], f.size()).astype(np.int64), 0
                    while i < len(index):
                        begin = int(index["offset"][i])
                        j = max(i + 1, int(np.searchsorted(ends, begin + READ, side="right")))
                        part, i = index[i:j], j
                        data = f.read_at(int(ends[j - 1]) - begin, begin)
                        ids, counts, crcs = [], [], []
                        for o in part["offset"]:
                            payload, _ = unframe(data, int(o) - begin)
                            flag, doc = struct.unpack("<Bq", payload[:9])
                            tokens = np.frombuffer(payload, f"<u{flag & 0x0F}", offset=9)
                            ids.append(None if flag & NULL_ID else doc)
                            counts.append(len(tokens))
                            crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        counts = np.array(counts, np.int64)
                        starts = first + np.cumsum(counts) - counts
                        first += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "file string, start long")
    return listed.repartition(max(1, len(rows)), "file").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op10_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fresh_path(spark, "records")
    files = write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_records(spark, out, files).withColumnRenamed("id", "doc_id")

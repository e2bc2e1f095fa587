"""Secret scans: rule matches, and a character convolutional network over every other candidate.

Rules find assigned values, access keys and long hexadecimal runs. Candidates
are all runs of 12 or more token characters, or what a rule's spans leave of a run;
the network reads each in overlapping windows, with the text around them, and the
highest output counts. It is trained on the rules' own findings against other runs
of the same texts. So that it learns more than the rules, the naming key is cut out
of half of the findings, and every finding is drawn anew in other shapes: cut short,
or with random characters of other alphabets, prefixes and groups, in the surroundings
of other runs. Against them stand other runs joined from words of the texts, as names,
paths, versions and dates are. Outputs are calibrated on a held-back part, and the
threshold is the largest that keeps the wanted recall of the findings there whose key
is cut out and of those drawn anew. Rule spans always stay.

A null text is empty; it and an empty table give no spans. Very long texts are
scanned whole. Repeated rows each get their spans. Where fewer than MIN_EXAMPLES
findings or other runs exist there is no network, and only rules apply.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.text import hash_bound, in_parts
from weftline.sources.shared import written

# The rules.
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEYS = (b"password", b"passwd", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "model")
MIN_VALUE, MIN_ACCESS, MIN_CANDIDATE = 8, 16, 12
# End of fixed values.

TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
TO_TOKENS = bytes(c if c in TOKEN_BYTES else 32 for c in range(256))
_LOWER, _UPPER, _DIGIT = TOKEN_BYTES[26:52], TOKEN_BYTES[:26], TOKEN_BYTES[52:62]
_ALNUM = _LOWER + _UPPER + _DIGIT
LEFT, BODY, RIGHT = 24, 40, 16
STEP = BODY // 2
WINDOW = LEFT + BODY + RIGHT
#: Bounds of the training sample: documents with findings, other documents, examples of either label.
FINDING_DOCS, OTHER_DOCS, EXAMPLES = 1500, 1000, 6000
MIN_EXAMPLES = 20


def base_spans(b: bytes, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes by the rules; longest is the length of the longest token run."""
    out = []
    low = b.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(b) if m.end(2) - m.start(2) >= MIN_VALUE]
    if longest >= MIN_ACCESS and b"AKIA" in b:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(b) if m.end() - m.start() >= MIN_ACCESS]
    if longest >= 32:
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(b)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def runs(b: bytes, least: int = MIN_CANDIDATE) -> list[bytes]:
    return [w for w in b.translate(TO_TOKENS).split() if len(w) >= least]


def located(b: bytes, tokens: list[bytes]) -> list[tuple[int, int]]:
    """Where these runs stand, in order: each is searched from the end of the one before."""
    out, at = [], 0
    blank = b.translate(TO_TOKENS)
    for w in tokens:
        at = blank.index(w, at)
        while at and blank[at - 1] != 32 or at + len(w) < len(blank) and blank[at + len(w)] != 32:
            at = blank.index(w, at + 1)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def window(b: bytes, start: int, end: int, left_end: int | None = None) -> bytes:
    """A run and the text around it; the text before it ends at left_end, if given (where a key is cut out)."""
    left_end = start if left_end is None else left_end
    left = b[max(0, left_end - LEFT) : left_end]
    return left.rjust(LEFT, b"\0") + b[start : min(end, start + BODY)].ljust(BODY, b"\0") + b[end : end + RIGHT].ljust(RIGHT, b"\0")


def bodies(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping places of BODY bytes that cover a run, the last one at its end."""
    return [(at, at + BODY) for at in range(start, end - BODY, STEP)] + [(max(start, end - BODY), end)]


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no span (in order of their starts) covers."""
    out = []
    for x, y, _ in spans:
        if x >= end:
            break
        if x > start:
            out.append((start, x))
        start = max(start, y)
    return [*out, (start, end)] if start < end else out


def keyless(b: bytes, start: int, end: int, spans: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Where the value of a run begins and where the text before its key ends; both start if no key names it."""
    for x, y, kind in spans:
        if kind == 0 and x < end and start < y:
            value = ASSIGN.match(b, x).start(2)
            return max(start, value), x
    return start, start


#: Added to the bytes of a window's context, so that they have an embedding of their own.
_REGION = np.repeat([256, 0, 256], [LEFT, BODY, RIGHT])


class CharCNN:
    """Byte embedding (context apart), one convolution, ReLU, maximum and mean over positions, one output; plain numpy."""

    def __init__(self, seed: int = 42, dim: int = 8, filters: int = 32, width: int = 5):
        r = np.random.default_rng(seed)
        self.width, self.rng = width, r
        p = {"e": r.normal(0, 0.3, (512, dim)), "k": r.normal(0, 0.2, (width * dim, filters)), "c": np.zeros(filters), "v": r.normal(0, 0.2, filters), "u": r.normal(0, 0.2, filters), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        p, w = self.p, self.width
        n = x.shape[1] - w + 1
        e = p["e"][x + _REGION]
        cols = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
        z = (cols.reshape(-1, cols.shape[2]) @ p["k"] + p["c"]).reshape(len(x), n, -1)
        act = np.maximum(z, 0)
        top, mean = act.max(axis=1), act.mean(axis=1)
        return top @ p["v"] + mean @ p["u"] + p["b"][0], (cols, act, top, mean)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01) -> None:
        """Adam on the logistic loss, both labels weighing alike."""
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        dim, step, steps = self.p["e"].shape[1], 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for i in range(0, len(x), batch):
                b = order[i : i + batch]
                out, (cols, act, top, mean) = self._forward(x[b])
                d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[b]) * weight[b] / len(b)).astype(np.float32)
                n = act.shape[1]
                dz = np.broadcast_to(d[:, None, None] * self.p["u"] / n, act.shape) + d[:, None, None] * self.p["v"] * (act == top[:, None])
                dz = (dz * (act > 0)).reshape(-1, act.shape[2])
                g = {"v": top.T @ d, "u": mean.T @ d, "b": np.array([d.sum()]), "c": dz.sum(0), "k": cols.reshape(-1, cols.shape[2]).T @ dz}
                de = (dz @ self.p["k"].T).reshape(len(b), n, self.width, dim)
                at = np.zeros((len(b), x.shape[1], dim), np.float32)
                for k in range(self.width):
                    at[:, k : k + n] += de[:, :, k]
                code = (x[b] + _REGION).ravel()
                g["e"] = np.stack([np.bincount(code, weights=at[:, :, k].ravel(), minlength=512) for k in range(dim)], axis=1)
                step += 1
                for k, (m, v) in state.items():
                    m += 0.1 * (g[k] - m)
                    v += 0.001 * (g[k] ** 2 - v)
                    # The rate falls to a tenth in even steps.
                    self.p[k] -= rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[0] for i in range(0, len(x), 256)] or [np.zeros(0)])

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, keyless: np.ndarray | None = None) -> None:
        """Logistic scaling of the outputs, then the largest threshold that keeps this recall of the findings
        (of those marked in keyless, if there are any: candidates show no key)."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(300):
            d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
            a, b = a - 0.02 * ((d * z).mean() + 0.01 * (a - 1)), b - 0.02 * d.mean()
        self.scale, self.shift = a, b
        wanted = y == 1 if keyless is None or not keyless.any() else keyless
        found = np.sort(self.probability(x[wanted]))
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 1.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))


def as_array(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)


def drawn_anew(value: bytes, rng: np.random.Generator) -> bytes:
    """A finding in another shape: cut short, with other characters of the same kinds, or of other alphabets."""
    pick = lambda alphabet, n: bytes(rng.choice(np.frombuffer(alphabet, np.uint8), n))
    n = int(rng.integers(16, BODY + 1))
    kind = int(rng.integers(7))
    if kind == 0 and len(value) > 16:
        cut = int(rng.integers(16, len(value)))
        at = int(rng.integers(len(value) - cut + 1))
        return value[at : at + cut]
    if kind <= 1:
        return b"".join(pick(_DIGIT if c in _DIGIT else _UPPER if c in _UPPER else _LOWER, 1) if c in _ALNUM else bytes([c]) for c in value)
    if kind == 2:
        return pick(_ALNUM + b"+/", n)
    if kind == 3:
        return pick((_DIGIT + _LOWER, _DIGIT + _UPPER)[int(rng.integers(2))], n)
    if kind == 4:
        return pick(_DIGIT + b"abcdef", n)
    if kind == 5:
        return pick(_LOWER, int(rng.integers(2, 6))) + pick(b"_-.", 1) + pick(_ALNUM, n)
    return b"-".join(pick(_ALNUM if rng.integers(2) else _DIGIT, int(rng.integers(8, 13))) for _ in range(3)) + pick(_ALNUM, 8)


def joined_words(words: list[bytes], rng: np.random.Generator) -> bytes:
    """What no secret looks like: words of the texts joined as long words, names, paths, versions, dates and addresses are."""
    some = [words[int(i)] for i in rng.integers(len(words), size=int(rng.integers(2, 5)))]
    if not rng.integers(3):
        some = [w.upper() for w in some]
    number = b"%d" % rng.integers(10 ** int(rng.integers(1, 5)))
    kind = int(rng.integers(7))
    if kind == 6:
        return b"".join(some) + b"."[: int(rng.integers(2))]
    if kind == 0:
        return b"-_./"[(at := int(rng.integers(4))) : at + 1].join(some)
    if kind == 1:
        return some[0] + b"".join(w.capitalize() for w in some[1:]) + (number if rng.integers(2) else b"")
    if kind == 2:
        return b".".join([some[0] + number, *some[1:], b"com"])
    if kind == 3:
        return b"%s-%d.%d.%d" % (some[0], *rng.integers(30, size=3)) + (b"-" + some[1] if rng.integers(2) else b"")
    if kind == 4:
        return b"%d-%02d-%02d" % (rng.integers(1970, 2040), rng.integers(1, 13), rng.integers(1, 29)) + (b"T%02d" % rng.integers(24) if rng.integers(2) else b"/" + some[0])
    return b"/".join([b"", *some, number])


def _examples(docs: DataFrame) -> DataFrame:
    """(label, window) of the token runs of these documents: where a rule's span touches the run, 1, or 2 with the key cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole, 0)):
            label, windows = [], []
            for t in batch.column(0).to_pylist():
                b = (t or "").encode()
                tokens = runs(b, 8)
                base = base_spans(b, max(map(len, tokens), default=0))
                for s, e in located(b, tokens):
                    # What the spans leave of a run is no example of other runs: it may belong to the secret.
                    rest = outside(s, e, base)
                    hit = rest != [(s, e)]
                    if hit:
                        s, e = rest[0][1] if rest and rest[0][0] == s else s, rest[-1][0] if rest and rest[-1][1] == e else e
                    if e - s >= MIN_CANDIDATE:
                        cut = hit and len(label) % 2 == 1
                        label.append(int(hit) + cut)
                        at, left_end = keyless(b, s, e, base) if cut else (s, s)
                        for x, y in bodies(at, e):
                            windows.append(window(b, x, y, left_end if x == at else None))
                        label += label[-1:] * (len(windows) - len(label))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(windows, pa.binary())], ["label", "window"])

    return docs.mapInArrow(run, "label int, window binary")


def _reshaped(windows: list[bytes], labels: list[int], seed: int) -> tuple[list[bytes], list[int]]:
    """As many windows drawn anew from these: findings in other shapes and joined words, in the surroundings of other runs."""
    rng = np.random.default_rng(seed)
    around = [(w[:LEFT], w[LEFT + BODY :]) for w, k in zip(windows, labels, strict=True) if not k] or [(b" " * LEFT, b" " * RIGHT)]
    words = sorted({x for left, right in around for x in re.findall(rb"(?<=[^A-Za-z])[A-Za-z]{3,12}(?=[^A-Za-z])", left + b" " + right)}) or [b"word"]
    found = [w[LEFT : LEFT + BODY].rstrip(b"\0") for w, k in zip(windows, labels, strict=True) if k]
    out: list[bytes] = []
    for make, n in ((lambda: drawn_anew(found[int(rng.integers(len(found)))], rng), len(windows) // 2), (lambda: joined_words(words, rng), len(windows) // 2)):
        for _ in range(n):
            left, right = around[int(rng.integers(len(around)))]
            body = make()
            out.append(left + body[:BODY].ljust(BODY, b"\0") + (body[BODY:] + right)[:RIGHT])
    return out, [2] * (len(out) // 2) + [0] * (len(out) // 2)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98, seed: int = 42) -> CharCNN | None:
    """Fit on a bounded sample: the documents of either kind with the least hashes (FINDING_DOCS, OTHER_DOCS), EXAMPLES windows of
    either label, and as many drawn anew from them (what is held back is drawn from what is held back)."""
    text = docs[text_col].alias("text")
    low = F.lower("text")
    src = docs.where(docs[text_col].isNotNull()).select(text, F.xxhash64(docs[id_col], docs[text_col], F.lit(seed)).alias("h"))
    some = F.col("text").contains("AKIA") | low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    n = src.agg(F.count_if(some), F.count_if(~some)).first()
    found, other = (src.where(w & (F.col("h") <= hash_bound(src.where(w), limit, n=m))) for w, limit, m in ((some, FINDING_DOCS, n[0]), (~some, OTHER_DOCS, n[1])))
    windows = [written(docs.sparkSession, _examples(d.select("text")).distinct().withColumn("h", F.xxhash64("window")), "examples") for d in (found, other)]
    rows = [r for w in windows for k in (False, True) for r in w.where((F.col("label") > 0) == k).orderBy("h").limit(EXAMPLES // 2).collect()]
    rows = list({bytes(r.window): r for r in rows}.values())
    if min(sum(r.label > 0 for r in rows), sum(r.label == 0 for r in rows)) < MIN_EXAMPLES:
        return None
    held = [r.h % 4 == 0 for r in rows]
    if not 0 < sum(r.label > 0 for r, h in zip(rows, held, strict=True) if h) or not any(h and r.label == 0 for r, h in zip(rows, held, strict=True)):
        held = [None] * len(rows)
    parts = []
    for k, wanted in enumerate(((False, None), (True, None))):
        own = [(bytes(r.window), r.label) for r, h in zip(rows, held, strict=True) if h in wanted]
        w, label = map(list, zip(*own, strict=True))
        more, more_labels = _reshaped(w, label, seed + k)
        parts.append((as_array(w + more), np.array(label + more_labels)))
    net = CharCNN(seed)
    (x, label), (held_x, held_label) = parts
    net.fit(x, (label > 0).astype(np.float32))
    net.calibrate(held_x, (held_label > 0).astype(float), recall, held_label == 2)
    return net


def spans_of(texts: list[str | None], net: CharCNN | None) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of each text in code points, by start and kind; the network sees all their candidates at once."""
    found, windows, first, owner, places, raw = [], [], [], [], [], []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        tokens = runs(b)
        base = base_spans(b, max(map(len, tokens), default=0))
        raw.append(b)
        found.append(base)
        if net is not None:
            for s, e in located(b, tokens):
                for x, y in outside(s, e, base):
                    if y - x >= MIN_CANDIDATE:
                        first.append(len(windows))
                        windows += [window(b, *body) for body in bodies(x, y)]
                        owner.append(i)
                        places.append((x, y, 3))
    if windows:
        for i, place, p in zip(owner, places, np.maximum.reduceat(net.probability(as_array(windows)), first), strict=True):
            if p >= net.threshold:
                found[i].append(place)
    for i, spans in enumerate(found):
        spans.sort(key=lambda s: (s[0], s[2]))
        if spans and not texts[i].isascii():
            points = np.concatenate(([0], np.cumsum((np.frombuffer(raw[i], np.uint8) & 0xC0) != 0x80)))
            found[i] = [(int(points[s]), int(points[e]), k) for s, e, k in spans]
    return found


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, net: CharCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in in_parts(batch)):
            all_spans = spans_of(b.column(1).to_pylist(), net)
            base = [[s for s in spans if s[2] < 3] for spans in all_spans]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            sha = [hashlib.sha256(digest(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha), pa.array([digest(s) for s in all_spans])], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: CharCNN | None, text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by a mark; null stays null, other columns stay as they are."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in in_parts(batch, place)):
            texts = b.column(place).to_pylist()
            new = [t if not s else redacted(t, s) for t, s in zip(texts, spans_of(texts, net), strict=True)]
            yield b.set_column(place, b.schema.field(place), pa.array(new, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs)).withColumnRenamed("id", "doc_id")

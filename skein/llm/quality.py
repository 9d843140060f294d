"""Quality rules: base rules and a calibrated n-gram logistic regression.

The model sees hashed word 1- and 2-grams and hashed character 3- and 5-grams,
each block as relative frequencies.  It is fitted on labelled rows, calibrated on
labelled rows it was not fitted on, and scored in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import arrow_map, mix, utf8, window_hashes, word_hashes

#: Rows of each label used for fitting and calibration, at most; of more, those
#: with the smallest hash of their id are taken.
MAX_LABELLED = 4_000
#: Buckets of each of the four feature blocks.
BUCKETS = 1 << 15
BLOCKS = 4
#: Features that a step of fitting works on at a time, about.
CHUNK = 1 << 20
#: A text is kept if its calibrated probability of good quality reaches this.
KEEP_AT = 0.5

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_TAIL_BYTES = bytes(range(0x80, 0xC0))
_WINDOW = 8


def base_counts(data: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    word_chars = len(data.translate(None, _SPACE + _TAIL_BYTES))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return word_chars, symbols, len(lines) - len(set(lines)), repeat_words(hashes)


def repeat_words(hashes: np.ndarray, k: int = _WINDOW) -> int:
    """Words covered by windows of ``k`` words that are found twice or more."""
    w = window_hashes(hashes, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def code_points(data: bytes) -> np.ndarray:
    """The characters of a UTF-8 text as numbers."""
    if data.isascii():
        return np.frombuffer(data, np.uint8).astype(np.uint32)
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def feature_ids(data: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Bucket of every n-gram of the text, one array for each block."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    c = code_points(data)
    out = [(mix(hashes) >> shift).astype(np.int32), (window_hashes(hashes, 2) >> shift).astype(np.int32)]
    top = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for k in (3, 5):
        n = max(len(c) - k + 1, 0)
        h = np.zeros(n, np.uint32)
        for i in range(k):
            h = h * np.uint32(0x01000193) ^ c[i : i + n]
        out.append(((h * np.uint32(0x9E3779B1)) >> top).astype(np.int32))
    return out


@dataclass
class QualityModel:
    """Weights of ``BLOCKS * BUCKETS`` features, a bias and a Platt scaling."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, blocks: list[np.ndarray]) -> float:
        w = self.weights
        return self.bias + sum(float(w[k][ids].mean()) for k, ids in enumerate(blocks) if len(ids))

    def probability(self, blocks: list[np.ndarray]) -> float:
        z = self.slope * self.margin(blocks) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                max_labelled: int = MAX_LABELLED, steps: int = 120) -> QualityModel:
    """Fit on the texts of labelled rows, label 0 or 1.

    At most ``max_labelled`` rows of each label are picked (smallest id hash
    first) before their texts are looked up, so what is broadcast to the
    documents is bounded.  Executors read the whole texts, as scoring does; a
    text sends its buckets and their counts, ``BLOCKS * BUCKETS`` at most,
    however long it is.  Null texts and labels are left out; repeated labels
    count once.  Of several rows with a labelled id the text with the smallest
    hash is learnt from, so an id that many rows have sends one text.  A fifth
    of the rows, chosen by id hash, only calibrates; probabilities are put back
    to the labels' true shares.  With one class only, or too few rows, the
    model gives every text the smoothed base rate.
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple, tuple[int, bytes]] = {}
        for batch in batches:
            for key, data in zip(zip(*(batch.column(k).to_pylist() for k in range(3))), utf8(batch, "text")):
                h = xxhash.xxh3_64_intdigest(data) >> 1
                if key not in least or h < least[key][0]:
                    least[key] = h, data
        found = [(*key, h, *_pack(data)) for key, (h, data) in least.items()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        columns = zip(*found) if found else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["rank", "id", "label", "h", "size", "packed"])

    keyed = labels.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("rank")).where("label in (0, 1) and id is not null").distinct()
    picked = [keyed.where(F.col("label") == k).orderBy("rank", "id").limit(max_labelled) for k in (0, 1)]
    total = {r["label"]: r["n"] for r in keyed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.where("text is not null").join(F.broadcast(picked[0].unionByName(picked[1])), "id").select("rank", "id", "label", "text")
    each = rows.mapInArrow(features, "rank long, id long, label int, h long, size int, packed binary")
    least = each.groupBy("rank", "id", "label").agg(F.min(F.struct("h", "size", "packed")).alias("x")).select("rank", "label", "x.size", "x.packed")
    got = sorted(map(tuple, least.collect()))
    y = np.array([r[1] for r in got], np.float64)
    held = np.array([r[0] % 5 == 0 for r in got], bool)
    weights = np.zeros((BLOCKS, BUCKETS))
    rate = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    few = lambda x: min(x.sum(), len(x) - x.sum()) < 5
    if few(y[held]) or few(y[~held]):
        return QualityModel(weights, float(np.log(rate / (1 - rate))))
    sizes = np.array([r[2] for r, h in zip(got, held) if not h], np.int64)
    col, val = np.empty(sizes.sum(), np.int32), np.empty(sizes.sum(), np.float32)
    for end, n, i in zip(np.cumsum(sizes), sizes, np.flatnonzero(~held)):
        col[end - n : end], val[end - n : end] = _unpack(got[i][3])
    at, bias = _descend(col, val, sizes, y[~held], steps)
    model = QualityModel(at.reshape(BLOCKS, BUCKETS), bias)
    tested = (_unpack(got[i][3]) for i in np.flatnonzero(held))
    z = np.array([bias + at[ids] @ vals for ids, vals in tested])
    model.slope, model.offset = _platt(z, y[held])
    model.offset += float(np.log(total[1] / total[0]) - np.log(y[held].sum() / (held.sum() - y[held].sum())))
    return model


def _pack(data: bytes) -> tuple[int, bytes]:
    """Number of features of a text, and its buckets and their counts."""
    found = [np.unique(x, return_counts=True) for x in feature_ids(data, word_hashes(data.split()))]
    sizes = np.array([len(u) for u, _ in found], np.int64)
    counts, at = [n.astype(np.uint32) for _, n in found], [u.astype(np.uint16) for u, _ in found]
    return int(sizes.sum()), zlib.compress(b"".join(x.tobytes() for x in (sizes, *counts, *at)), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and relative frequencies from ``_pack``."""
    raw = zlib.decompress(packed)
    sizes = np.frombuffer(raw, np.int64, BLOCKS)
    n = int(sizes.sum())
    counts = np.frombuffer(raw, np.uint32, n, sizes.nbytes)
    block = np.repeat(np.arange(BLOCKS), sizes)
    ids = BUCKETS * block + np.frombuffer(raw, np.uint16, n, sizes.nbytes + counts.nbytes)
    return ids.astype(np.int32), (counts / np.bincount(block, counts, BLOCKS)[block]).astype(np.float32)


def _descend(col: np.ndarray, val: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Full-batch Adam on features scaled to unit mean square; deterministic.

    ``sizes`` features of each row follow one another.  They are gone through
    in chunks of whole rows, so nothing else of their number is held.
    """
    n, size = len(y), BLOCKS * BUCKETS
    ends = np.cumsum(sizes)
    rows = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], CHUNK)), n))
    chunks = [(slice(a, b), slice(ends[a] - sizes[a], ends[b - 1])) for a, b in zip(np.append(0, rows), rows) if b > a]
    square = np.zeros(size)
    for _, c in chunks:
        square += np.bincount(col[c], val[c] ** 2, size)
    scale = 1 / np.sqrt(square / n + 1e-9)
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    for t in range(1, steps + 1):
        ws, g, gb = w * scale, np.zeros(size), 0.0
        for r, c in chunks:
            some = sizes[r] > 0
            z = np.full(len(some), bias)
            if some.any():
                z[some] += np.add.reduceat(ws[col[c]] * val[c], (np.cumsum(sizes[r]) - sizes[r])[some])
            e = each[r] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[r])
            g += np.bincount(col[c], np.repeat(e, sizes[r]) * val[c], size)
            gb += e.sum()
        g = g * scale + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= a * m / (np.sqrt(v) + 1e-8)
        bias -= a * mb / (np.sqrt(vb) + 1e-8)
    return w * scale, float(bias)


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps, with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        r = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def quality(spark: SparkSession, docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base verdict, probability and ``kept`` for every row.

    Null and empty texts have no words and fail the base rules.  Repeated rows
    give a row each; other columns are not read.  Whole texts are read in Arrow
    batches without a shuffle; the model is broadcast and of fixed size
    (``BLOCKS * BUCKETS`` doubles, 1 MB).
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in utf8(batch, "text"):
            data = data or b""
            words = data.split()
            h = word_hashes(words)
            base = base_counts(data, words, h)
            failed = len(words) < 20 or 100 * base[3] > 30 * len(words)
            p = sent.value.probability(feature_ids(data, h))
            rows.append((len(words), *base, failed, not failed and p >= keep_at, p))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *cols],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"],
        )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double",
    )

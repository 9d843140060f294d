"""Language identification by bit-sliced Bloom filters of n-grams.

Every cell of the filter is a bit mask with one bit for each language, so one
look-up answers for all languages at once: the masks of an n-gram's cells,
ANDed, name every language that holds the n-gram.  A text's languages are
ranked by how many of its n-grams they hold, less the false positives that a
filter as full as theirs is bound to give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import arrow_map, utf8

#: Bytes of an n-gram.
N = 4
#: Cells of the filter and hashes of an n-gram; the size is fixed.
CELLS = 1 << 18
HASHES = 3
#: Labelled texts of one language used for learning, about; more are thinned by
#: id hash.  Whole texts are read, in learning as in prediction.
TEXTS_PER_LANG = 800
#: N-grams of a text that are looked up at a time.
CHUNK = 1 << 20
#: An n-gram is a language's if at least this share of its texts has it.
MIN_SHARE = 0.01
UNKNOWN = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def gram_chunks(data: bytes) -> Iterator[np.ndarray]:
    """The text's ``N``-byte n-grams, lower-cased (A-Z), edges padded."""
    padded = np.frombuffer(b"  " + data.lower() + b"  ", np.uint8)
    for lo in range(0, len(padded) - N + 1, CHUNK):
        b = padded[lo : lo + CHUNK + N - 1].astype(np.uint32)
        n = len(b) - N + 1
        out = np.zeros(n, np.uint32)
        for i in range(N):
            out = out << np.uint32(8) | b[i : i + n]
        yield out


def has_letter(data: bytes | None) -> bool:
    if not data:
        return False
    return bool(_ASCII_LETTER.search(data)) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def cells_of(g: np.ndarray, k: int) -> np.ndarray:
    h = g * np.uint32(_MULTIPLIERS[k])
    h ^= h >> np.uint32(15)
    h *= np.uint32(_MULTIPLIERS[(k + 1) % 5])
    return h >> np.uint32(32 - (CELLS.bit_length() - 1))


@dataclass
class LanguageFilter:
    """``cells``: a word of the language mask for each cell, one row for every
    64 languages (8 bits are enough for up to 8); ``false_rate`` by language."""

    langs: list[str]
    cells: np.ndarray
    false_rate: np.ndarray

    def holders(self, g: np.ndarray) -> np.ndarray:
        """Mask of the languages that hold each n-gram."""
        mask = self.cells[:, cells_of(g, 0)]
        for k in range(1, HASHES):
            mask &= self.cells[:, cells_of(g, k)]
        return mask

    def held(self, g: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language holds."""
        mask = self.holders(g)
        if self.cells.dtype == np.uint8:
            by_mask = np.bincount(mask[0], minlength=256)
            return np.array([by_mask[(np.arange(256) >> k) & 1 == 1].sum() for k in range(len(self.langs))])
        bits = [np.count_nonzero(w >> np.uint64(k) & np.uint64(1)) for w in mask for k in range(64)]
        return np.array(bits[: len(self.langs)])

    def predict(self, data: bytes | None) -> tuple[str, float]:
        if not self.langs or not has_letter(data):
            return UNKNOWN, 0.0
        counts, n = np.zeros(len(self.langs), np.int64), 0
        for g in gram_chunks(data):
            counts += self.held(g)
            n += len(g)
        fair = np.maximum(counts - n * self.false_rate, 0) / (1 - self.false_rate)
        best = int(fair.argmax())
        return self.langs[best], float(min(fair[best] / n, 1.0))


def held_out(id_col: str) -> F.col:
    """True where crc32 of the id as text leaves 0 modulo 5 (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          texts_per_lang: int = TEXTS_PER_LANG) -> LanguageFilter:
    """Learn from rows that are not held out and have an id, text and lang.

    About ``texts_per_lang`` texts of each language are read whole, thinned by
    a hash of the id, so the work after the count is bounded.  N-gram counts
    are summed within batches, then by Spark, which also sets the filter's
    bits; the driver gets a row for each word of a cell that is not empty:
    ``CELLS`` of them for every 64 languages, however much was learnt.
    """
    usable = docs.where(~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.col(id_col).cast("string").alias("id"),
    ).where("lang is not null and text is not null and id is not null")
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    words = max(1, -(-len(langs) // 64))
    cells = np.zeros((words, CELLS), kind)
    if not langs:
        return LanguageFilter([], cells, np.zeros(0))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_lang: dict[int, list[np.ndarray]] = {}
        for k, data in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
            each = [np.unique(g) for g in gram_chunks(data)]
            by_lang.setdefault(k, []).append(each[0] if len(each) == 1 else np.unique(np.concatenate(each)))
        out = []
        for k, each in by_lang.items():
            g, n = np.unique(np.concatenate(each), return_counts=True)
            out.append((np.full(len(g), k), g, n))
        k, g, n = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (k, g, n)], names=["k", "g", "n"])

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, g = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
        cell = np.concatenate([cells_of(g, i) for i in range(HASHES)]).astype(np.int64)
        bit = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
        word, bit = np.tile(k // 64, HASHES), np.tile(bit, HASHES)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(cell), pa.array(bit)], names=["word", "cell", "bits"])

    def bounds(lang: str) -> tuple[float, float]:
        used = min(totals[lang], texts_per_lang)
        return min(1.0, texts_per_lang / totals[lang]), max(2.0 if used > 20 else 1.0, MIN_SHARE * used)

    known = F.broadcast(docs.sparkSession.createDataFrame([(x, k, *bounds(x)) for k, x in enumerate(langs)], "lang string, k long, most double, least double"))
    share = F.pmod(F.xxhash64("id", F.lit("learn")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = usable.join(known, "lang").where(share < F.col("most")).select("k", "text")
    frequent = arrow_map(picked, count, "k long, g long, n long").groupBy("k", "g").agg(F.sum("n").alias("n"))
    frequent = frequent.join(known, "k").where("n >= least").select("k", "g")
    rows = arrow_map(frequent, bits, "word long, cell long, bits long").groupBy("word", "cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    cells[rows["word"].to_numpy(np.int64), rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(kind)
    full = np.array([np.count_nonzero(cells[k // 64] >> kind(k % 64) & kind(1)) / CELLS for k in range(len(langs))])
    return LanguageFilter(langs, cells, full**HASHES)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row.

    Only the text is read for a prediction.  Null texts and texts without a
    letter are ``und`` with score 0; ties go to the language with more learning
    texts, then by name; repeated rows give a row each; other columns are not
    read.  The filter is broadcast: 2 MB for every 64 languages.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [sent.value.predict(x) for x in utf8(batch, "text")]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")),
        run, "doc_id long, held_out boolean, lang_pred string, score double",
    )


def keep_identified(spark: SparkSession, docs: DataFrame, model: LanguageFilter, min_score: float = 0.2, text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, whose language is recognised.

    Rejected: ``und`` (null texts and texts without a letter, too), and scores
    below ``min_score``, the share of n-grams that the best language holds
    beyond chance.  Rows are judged one by one, repeated ones alike; columns of
    any name are passed through, as they are.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [sent.value.predict(x) for x in utf8(batch, text_col)]
        return batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in got], pa.bool_()))

    return arrow_map(docs, run, docs.schema)

"""Benchmark decontamination by a positional inverted index of the corpus.

The index is cut by documents into segments, like a search engine's: each is
one row with a few megabytes of text's postings, term by term, positions
ascending.  It is stored once in the shared folder; document frequencies are
summed over all segments.  A phrase is looked up from its rarest term: that
term's positions, less its offset, are the candidate starts, and each further
term, in order of rarity, cuts them to those it stands at too.  What is left
are exact matches.  Proximity matches come from the same lists with slack, and
start at each of a window's rarest terms, as many as a match may lack and one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import map_batches, stage_table, word_hashes

#: Words of a window.
WINDOW = 13
#: Bytes of text in a segment, about.
SEGMENT_BYTES = 4 << 20
#: Bytes of benchmark text looked up at a time; more are looked up in blocks.
BLOCK_BYTES = 8 << 20
#: A proximity match has this many of a window's words within so many places,
#: counted from where one of the rarest of them puts the window.
NEAR_WORDS, NEAR_SLACK = 11, 3
#: Starts of proximity matches looked at together, about.
NEAR_STARTS = 1 << 19
#: Places between documents, so that no window and no slack spans two.
_GAP = WINDOW + 2 * NEAR_SLACK

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    return data.translate(_LOWER).split() if data else []


class Phrases:
    """A block of items as term numbers, and its windows.

    What is sent to the executors is a number for each word of the block, its
    terms and their counts; windows and their orders are made where they are
    looked up, once a process, as 4 and 1 bytes for each of their words.
    """

    def __init__(self, terms: list[bytes], words: np.ndarray, sizes: list[int], ids: list[str | None], window: int = WINDOW):
        self.terms, self.words, self.sizes, self.ids, self.window = terms, words, sizes, ids, window
        self.counts = np.zeros(len(terms), np.int64)
        self._made = False

    def by_rarity(self, counts: np.ndarray) -> "Phrases":
        self.counts, self._made = counts, False
        return self

    def make(self) -> "Phrases":
        """``windows`` (-1 pads short ones), their ``length`` and ``item``, and
        ``order``: their offsets, rarest term first."""
        if not self._made:
            each = [np.zeros((0, self.window), np.int32)]
            length, at = [], 0
            for n in self.sizes:
                k = min(self.window, n)
                found = np.lib.stride_tricks.sliding_window_view(self.words[at : at + n], k)
                each.append(np.pad(found, ((0, 0), (0, self.window - k)), constant_values=-1))
                length.append(np.full(len(found), k))
                at += n
            self.windows = np.concatenate(each)
            self.length = np.concatenate([np.zeros(0, np.int64), *length]).astype(np.int64)
            self.item = np.repeat(np.arange(len(self.sizes)), [len(x) for x in length])
            self.order = np.empty(self.windows.shape, np.int8)
            known = np.append(self.counts, np.iinfo(np.int64).max)
            for lo in range(0, len(self.windows), 1 << 16):
                self.order[lo : lo + (1 << 16)] = np.argsort(known[self.windows[lo : lo + (1 << 16)]], axis=1, kind="stable")
            rarest = self.windows[np.arange(len(self.windows)), self.order[:, 0]]
            self.by_first = np.argsort(rarest, kind="stable")
            self.first_sizes = np.bincount(rarest, minlength=len(self.terms))
            self._made = True
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("terms", "words", "sizes", "ids", "window", "counts")} | {"_made": False}


def phrases_of(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Phrases:
    terms: dict[bytes, int] = {}
    numbers, sizes, ids = [np.zeros(0, np.int32)], [], []
    for name, data in items:
        words = words_of(data)
        if words:
            numbers.append(np.array([terms.setdefault(w, len(terms)) for w in words], np.int32))
            sizes.append(len(words))
            ids.append(name)
    return Phrases(list(terms), np.concatenate(numbers), sizes, ids, window)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The benchmark on the driver, ``most`` bytes of text at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    for r in rows.toLocalIterator():
        block.append((r["id"], bytes(r["text"]) if r["text"] is not None else None))
        size += len(block[-1][1] or b"")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


_SEGMENT = "seg bigint, ids array<bigint>, n_words array<bigint>, terms binary, counts binary, positions binary"


def build_index(spark: SparkSession, docs: DataFrame, terms: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments over all rows, in the shared folder.

    With ``terms``, postings of those words only are stored: the semi-join with
    the test words happens before anything is written.  Without, all are.  A
    term is known by its 64-bit hash.  Each row of ``docs`` is in one segment;
    null ids and repeated ids stay rows of their own.
    """
    sent = spark.sparkContext.broadcast(None if terms is None else {w: k for k, w in enumerate(terms)})

    def number(words: list[bytes]) -> np.ndarray:
        if sent.value is None:
            return word_hashes(words)
        return np.fromiter(map(sent.value.get, words, repeat(-1)), np.int32, len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = None if sent.value is None else word_hashes(list(sent.value))
        ids, n_words, found, size = [], [], [], 0
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(data)
                ids.append(doc)
                n_words.append(len(words))
                found.append(number(words))
                size += len(data or b"")
                if size >= SEGMENT_BYTES:
                    yield _segment(seg, ids, n_words, found, hashes)
                    ids, n_words, found, size, seg = [], [], [], 0, seg + 1
        if ids:
            yield _segment(seg, ids, n_words, found, hashes)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return stage_table(map_batches(rows, run, _SEGMENT), "postings")


def _places(n_words: np.ndarray) -> np.ndarray:
    """Position of each document's first word."""
    return np.cumsum(n_words + _GAP) - n_words


def _one_row(values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values.values()], names=list(values))


_LONGS = pa.list_(pa.int64())


def _segment(seg: int, ids: list, n_words: list[int], found: list[np.ndarray], hashes: np.ndarray | None) -> pa.RecordBatch:
    tokens = np.concatenate(found)
    where = np.arange(len(tokens)) if hashes is None else np.flatnonzero(tokens >= 0)
    before = _places(np.array(n_words, np.int64)) - (np.cumsum(n_words) - n_words)
    places = where + np.repeat(before, n_words)[where]
    order = np.argsort(tokens[where], kind="stable")
    terms, counts = np.unique(tokens[where], return_counts=True)
    return _one_row({
        "seg": (seg, pa.int64()), "ids": (ids, _LONGS), "n_words": (n_words, _LONGS),
        "terms": ((terms if hashes is None else hashes[terms]).astype(np.uint64).tobytes(), pa.binary()),
        "counts": (counts.astype(np.int32).tobytes(), pa.binary()),
        "positions": (places[order].astype(np.uint32).tobytes(), pa.binary()),
    })


def term_counts(spark: SparkSession, index: DataFrame, p: "Phrases") -> np.ndarray:
    """Occurrences of each test term in the whole corpus."""
    sent = spark.sparkContext.broadcast(p.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, total = Numbers(sent.value), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, known = numbers.of(np.frombuffer(t, np.uint64))
                total[at[known]] += np.frombuffer(c, np.int32)[known]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["t", "n"])

    out = np.zeros(max(len(p.terms), 1), np.int64)
    got = map_batches(index.select("terms", "counts"), run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    out[got["t"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


class Numbers:
    """A block's term numbers from term hashes."""

    def __init__(self, terms: list[bytes]):
        h = word_hashes(terms)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.sorted):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return self.order[at], self.sorted[at] == hashes


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each element of the given runs, and the run it belongs to."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(run)), run


def look_up(p: Phrases, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, size: int, near: bool):
    """Exact ``(window, start)`` matches in one segment, and proximity ones."""
    here = np.zeros(max(len(p.terms), 1), np.int64)
    begin = np.zeros(max(len(p.terms), 1), np.int64)
    here[terms], begin[terms] = counts, np.cumsum(counts) - counts
    tokens = np.full(size + 2 * _GAP, -1, np.int32)
    tokens[positions + np.uint32(_GAP)] = np.repeat(terms, counts)
    # Windows come in by their rarest term, if the segment has it.
    starts = np.cumsum(p.first_sizes) - p.first_sizes
    some = p.by_first[_ragged(starts[terms], p.first_sizes[terms])[0]]
    some = some[np.all((here[p.windows[some]] > 0) | (p.windows[some] < 0), axis=1)]
    rarest = p.order[:, 0].astype(np.int64)
    first = p.windows[some, rarest[some]]
    at, run = _ragged(begin[first], here[first])
    exact_w = some[run]
    exact_s = positions[at].astype(np.int64) - rarest[exact_w] + _GAP
    for k in range(1, p.windows.shape[1]):
        offset = p.order[exact_w, k].astype(np.int64)
        term = p.windows[exact_w, offset]
        stay = (term < 0) | (tokens[exact_s + offset] == term)
        exact_w, exact_s = exact_w[stay], exact_s[stay]
    near_w, near_s = _look_near(p, here, begin, positions, tokens) if near else (exact_w[:0], exact_s[:0])
    return exact_w, exact_s - _GAP, near_w, near_s - _GAP


def _look_near(p: Phrases, here: np.ndarray, begin: np.ndarray, positions: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proximity matches.  Of one more term than a match may lack, one is in it."""
    spare = p.length - np.minimum(NEAR_WORDS, p.length)
    lacking = np.count_nonzero((here[p.windows] == 0) & (p.windows >= 0), axis=1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(int(spare.max(initial=-1)) + 1):
        offset = p.order[:, k].astype(np.int64)
        term = p.windows[np.arange(len(p.windows)), offset]
        some = np.flatnonzero((spare >= k) & (lacking <= spare) & (here[term] > 0))
        cuts = np.flatnonzero(np.diff(np.cumsum(here[term[some]]) // NEAR_STARTS)) + 1
        for part in np.split(some, cuts):
            at, run = _ragged(begin[term[part]], here[term[part]])
            w = part[run]
            s, left = positions[at].astype(np.int64) - offset[w] + _GAP, spare[w]
            for j in range(p.windows.shape[1]):
                o = p.order[w, j].astype(np.int64)
                t = p.windows[w, o]
                hit = t < 0
                for slack in range(-NEAR_SLACK, NEAR_SLACK + 1):
                    hit |= tokens[s + o + slack] == t
                left = left - ~hit
                stay = left >= 0
                w, s, left = w[stay], s[stay], left[stay]
            out.append((w, s))
    return tuple(np.concatenate(x) for x in zip(*out))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", near: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Contamination of every row of ``docs``.

    ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids,
    near_item_ids)``; a word is hit if any exact occurrence of a window covers
    it, and a row is contaminated if a twentieth of its words are hit.

    Null and empty texts have no words, no hits and are clean.  Items without
    words have no windows.  A null item id still marks hits but is not listed;
    repeated ids are listed once.  Repeated rows and ids give a row each;
    other columns are not read.  An empty benchmark leaves every row clean.

    The corpus is read once, written as postings, and never shuffled.  The
    benchmark is looked up ``block_bytes`` at a time; a block's broadcast holds
    its distinct words and 4 bytes for each word.  Each block leaves its hits
    by segment, which meet their segment's rows at the end.  A benchmark of one
    block needs postings of its own words only; of more, all are stored.
    """
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    p = phrases_of(block)
    index = build_index(spark, docs, p.terms if following is None else None, id_col, text_col)
    hits = []
    while True:
        p.by_rarity(term_counts(spark, index, p))
        hits.append(stage_table(_match(spark, index, p, near), "hits"))
        if following is None:
            break
        p = phrases_of(following)
        following = next(blocks, None)
    found = reduce(DataFrame.unionByName, hits).groupBy("seg").agg(F.collect_list(F.struct("runs", "docs", "items", "near")).alias("hits"))
    return map_batches(index.select("seg", "ids", "n_words").join(found, "seg", "left").select("ids", "n_words", "hits"), _verdicts, _VERDICT)


_HITS = "seg bigint, runs binary, docs array<bigint>, items array<string>, near array<boolean>"
_VERDICT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, near_item_ids array<string>"


def _match(spark: SparkSession, index: DataFrame, p: Phrases, near: bool) -> DataFrame:
    """What one block hits: a row for each segment with a hit.

    ``runs``: where covered words begin and end in the segment.  ``docs`` and
    ``items``: documents, by their number in it, and items matched; ``near``
    says whether by proximity.
    """
    sent = spark.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value.make()
        numbers = Numbers(p.terms)
        for row in (r for b in batches for r in b.to_pylist()):
            n_words = np.array(row["n_words"], np.int64)
            first = _places(n_words)
            size = int(first[-1] + n_words[-1]) if len(first) else 0
            at, known = numbers.of(np.frombuffer(row["terms"], np.uint64))
            counts, positions = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["positions"], np.uint32)
            begin = np.cumsum(counts, dtype=np.int64) - counts
            take, run_of = _ragged(begin[known], counts[known])
            by = np.argsort(at[known][run_of], kind="stable")
            some = np.argsort(at[known], kind="stable")
            w, start, near_w, near_start = look_up(p, at[known][some], counts[known][some], positions[take][by], size, near)
            if not len(w) and not len(near_w):
                continue
            edge = np.zeros(size + _GAP + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + p.length[w], -1)
            turns = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False))
            pairs = [(d, i, False) for d, i in _by_doc(first, start, p, w)] + [(d, i, True) for d, i in _by_doc(first, near_start, p, near_w)]
            docs, items, close = map(list, zip(*pairs)) if pairs else ([], [], [])
            yield _one_row({"seg": (row["seg"], pa.int64()), "runs": (turns.astype(np.uint32).tobytes(), pa.binary()), "docs": (docs, _LONGS),
                            "items": (items, pa.list_(pa.string())), "near": (close, pa.list_(pa.bool_()))})

    return map_batches(index.select("seg", "n_words", "terms", "counts", "positions"), run, _HITS)


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of each segment, from all hits in it."""
    for row in (r for b in batches for r in b.to_pylist()):
        n_words = np.array(row["n_words"], np.int64)
        first = _places(n_words)
        names, close = ([set() for _ in n_words] for _ in range(2))
        covered = np.zeros(int(first[-1] + n_words[-1]) + 1 if len(first) else 1, bool)
        for hit in row["hits"] or ():
            turns = np.frombuffer(hit["runs"], np.uint32).tolist()
            for lo, hi in zip(turns[::2], turns[1::2]):
                covered[lo:hi] = True
            for d, name, is_near in zip(hit["docs"], hit["items"], hit["near"]):
                (close if is_near else names)[d].add(name)
        total = np.concatenate([[0], np.cumsum(covered)])
        n_hit = total[first + n_words] - total[first]
        yield pa.RecordBatch.from_arrays([
            pa.array(row["ids"], pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names], pa.string()),
            pa.array((n_hit > 0) & (20 * n_hit >= n_words)), pa.array([sorted(x) for x in names], pa.list_(pa.string())),
            pa.array([sorted(x) for x in close], pa.list_(pa.string())),
        ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "near_item_ids"])


def _by_doc(first: np.ndarray, start: np.ndarray, p: Phrases, window: np.ndarray) -> list[tuple[int, str]]:
    """Documents and the names of the items matched in them."""
    if not len(start):
        return []
    doc = np.searchsorted(first - _GAP, start, side="right") - 1
    pairs = np.unique(np.stack([doc, p.item[window]]), axis=1)
    return [(d, p.ids[i]) for d, i in pairs.T.tolist() if p.ids[i] is not None]

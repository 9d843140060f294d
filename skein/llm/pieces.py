"""Sampled piece segmentation by forward filtering, backward sampling.

A text's lattice has an edge for every vocabulary piece that matches at a
place.  Forward sums of path weights, then a walk back that draws each edge in
proportion to the weight of all paths through it, give one segmentation with
its exact probability.  The draws depend on the row's key and the place only,
so a row always gets the same pieces, on any machine and in any batch.

No piece with weight holds the blank mark after its first place, so the lattice
falls apart into independent chunks before every blank; forward tables are made
once for each distinct chunk of a batch and drawn from by all its occurrences.
A long chunk is cut further at places that no piece spans, through which every
path goes.  So a long text is segmented a stretch at a time.
Pieces join back to the text's bytes exactly; characters without a piece, and
the blank mark itself where the text has it, are spelled as byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, mix

MARK = "▁"
#: Weight of a piece: (2 + merge rank) ** -ALPHA.  The model's own scores are
#: merge ranks, not probabilities.
ALPHA = 1.0
#: Pieces scored below this are never used by the model itself.
LEAST_SCORE = -1e8
#: Characters of the texts that are segmented together, and rows whose texts
#: and ids are held at once.
BATCH_CHARS, ROWS_IN = 1 << 17, 1_024
#: Edges at one depth, and walks, from which on they are handled together.
FEW, FEW_WALKS = 48, 4
#: Rows that are given out together, at least.
ROWS_OUT = 256
#: Longer chunks are cut where no piece spans, about this often.
LONG_CHUNK = 4_096

_NOT_MARK = 0x110001  # stands for a mark that the text itself has
_M = np.uint64(0x9E3779B97F4A7C15)
_INSIDE = np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """Vocabulary, weights and a prefix table of a SentencePiece model file."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = np.full(256, -1, np.int32)
        self.table: list[bytes] = []
        usable: dict[str, int] = {}
        n = model.get_piece_size()
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                self.table.append(piece.replace(MARK, " ").encode())
                if model.get_score(i) > LEAST_SCORE or piece == MARK:
                    usable[piece] = i
        bad = [p for p in usable if MARK in p[1:]]
        if bad or (self.byte_ids < 0).any():
            raise ValueError(f"needs byte pieces and marks in first place only: {bad[:3]}")
        self.longest = max(map(len, usable))
        score = np.maximum([model.get_score(i) for i in range(n)], -n)
        self.weight = -alpha * np.log(2 + np.maximum(-score, 0))
        self.fallback_weight = -alpha * np.log(2.0 + n)
        # Hash of every prefix of a piece, and the piece's id or -1.
        prefixes: dict[str, int] = {}
        for p, i in usable.items():
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], -1)
            prefixes[p] = i
        by_length: dict[int, list[tuple[int, int]]] = {}
        for p, i in prefixes.items():
            h = 0
            for c in p:
                h = (h * int(_M) + ord(c) + 1) & (2**64 - 1)
            by_length.setdefault(len(p), []).append((h, i))
        self.prefix = {}
        for k, found in by_length.items():
            found.sort()
            if len({h for h, _ in found}) < len(found):
                raise ValueError("two prefixes share a hash")
            self.prefix[k] = np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found], np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text; the inverse of any segmentation of it."""
        return b"".join(map(self.table.__getitem__, ids)).decode()[1:]

    def edges(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every match; ``end`` of each place's chunk."""
        starts, lengths, ids = [], [], []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        single = np.zeros(len(codes), bool)
        for k in range(1, self.longest + 1):
            inside = at + k <= end[at]
            at, h = at[inside], h[inside]
            if k not in self.prefix or not len(at):
                break
            h = h * _M + codes[at + k - 1] + np.uint64(1)
            keys, piece = self.prefix[k]
            where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[where] == h
            at, h, piece = at[known], h[known], piece[where[known]]
            whole = piece >= 0
            if k == 1:
                single[at[whole]] = True
            starts.append(at[whole])
            lengths.append(np.full(np.count_nonzero(whole), k))
            ids.append(piece[whole])
        alone = np.flatnonzero(~single)
        starts.append(alone)
        lengths.append(np.ones(len(alone), np.int64))
        ids.append(np.full(len(alone), -1, np.int32))
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)

    def cut_nodes(self, chunk: str) -> list[int]:
        """Where to cut a chunk (text behind its mark) between places that no
        piece spans, each cut the first such place after ``LONG_CHUNK``."""
        out, n = [], len(chunk)
        last = 0
        for lo in range(0, n, BATCH_CHARS):
            # Pieces that begin up to the longest piece earlier reach in here.
            begin = max(0, lo - self.longest)
            raw = np.frombuffer(((MARK if begin == 0 else "") + chunk[begin : lo + BATCH_CHARS + self.longest]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            codes = np.where(raw == ord(MARK), np.uint64(_NOT_MARK), raw)
            shift = 1 if begin == 0 else 0
            if shift:
                codes[0] = ord(MARK)
            start, length, _ = self.edges(codes, np.full(len(codes), len(codes)))
            over = np.zeros(len(codes) + 1, np.int32)
            np.add.at(over, start + 1, 1)
            np.add.at(over, start + length, -1)
            free = np.flatnonzero(np.cumsum(over)[:-1] == 0) + begin - shift
            for v in free[(free >= lo) & (free < lo + BATCH_CHARS)].tolist():
                if v - last >= LONG_CHUNK and v < n:
                    out.append(v)
                    last = v
        return out

    def sample(self, texts: list[str | None], seeds: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, joined, and how many each text has.

        ``places``: the number of each text's first chunk, if it is a stretch
        of a longer one.  A null text has no chunk, an empty one an empty one.
        """
        # Chunks by their text; what is cut off a longer one has no mark before
        # it and is known by a tuple.
        number: dict[str | tuple[str], int] = {}
        occurrence, in_text, cut = [], [], []
        for t in texts:
            chunks = t.split(" ") if t is not None else []
            if t is not None and len(t) > LONG_CHUNK and max(map(len, chunks)) > LONG_CHUNK:
                at = [(k, lo, hi) for k, c in enumerate(chunks) for lo, hi in pairwise([0, *(self.cut_nodes(c) if len(c) > LONG_CHUNK else ()), len(c)])]
                cut.append((len(occurrence), at))
                occurrence += [number.setdefault((chunks[k][lo:hi],) if lo else chunks[k][:hi], len(number)) for k, lo, hi in at]
                in_text.append(len(at))
            else:
                occurrence += [number.setdefault(c, len(number)) for c in chunks]
                in_text.append(len(chunks))
        if not occurrence:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        chunk = np.array(occurrence, np.int64)
        text_of = np.repeat(np.arange(len(texts)), in_text)
        place, inside = np.arange(len(chunk)) - np.repeat(np.cumsum(in_text) - in_text, in_text), np.zeros(len(chunk), np.int64)
        for lo, at in cut:
            place[lo : lo + len(at)], inside[lo : lo + len(at)], _ = np.array(at, np.int64).T
        if places is not None:
            place = place + places[text_of]
        marked, names = np.ones(len(number), bool), [*number]
        if cut:
            marked = np.array([isinstance(c, str) for c in names])
            names = [c if isinstance(c, str) else c[0] for c in names]
        size = np.array([*map(len, names)], np.int64) + marked
        first = np.cumsum(size) - size
        whole = "".join(MARK + c if m else c for c, m in zip(names, marked)) if cut else MARK + MARK.join(names)
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = np.where(raw == ord(MARK), np.uint64(_NOT_MARK), raw)
        codes[first[marked]] = ord(MARK)
        edges = self._forward(codes, first, size)
        base = mix(seeds[text_of] + place.astype(np.uint64) * _M + inside.astype(np.uint64) * _INSIDE)
        return self._backward(raw, edges, first + np.arange(len(first)), size, chunk, text_of, base, len(texts))

    def _forward(self, codes, first, size):
        """Edges by end node, each with its cumulative share of the paths.

        A chunk of n characters has n + 1 nodes; nodes of all chunks are
        numbered through, so place p of chunk c is node p + c.
        """
        owner = np.repeat(np.arange(len(size)), size)
        start, length, piece = self.edges(codes, (first + size)[owner])
        weight = np.where(piece >= 0, self.weight[piece], self.fallback_weight)
        source = start + owner[start]
        target = source + length
        depth = start + length - first[owner[start]]
        order = np.lexsort((length, target, depth))
        source, target, weight, piece, depth = source[order], target[order], weight[order], piece[order], depth[order]
        alpha = np.zeros(len(codes) + len(size))
        share = np.empty(len(source))
        begin = np.zeros(len(alpha) + 1, np.int64)
        steps = np.flatnonzero(np.diff(depth, prepend=-1))
        ends = np.append(steps[1:], len(depth))
        # Where only a few long chunks are left, plain numbers are faster.
        wide = np.flatnonzero(ends - steps >= FEW)
        tail = int(wide[-1]) + 1 if len(wide) else 0
        for lo, hi in zip(steps[:tail].tolist(), ends[:tail].tolist()):
            value = alpha[source[lo:hi]] + weight[lo:hi]
            new = np.flatnonzero(np.diff(target[lo:hi], prepend=-1))
            top = np.maximum.reduceat(value, new)
            count = np.diff([*new, hi - lo])
            value = np.exp(value - np.repeat(top, count))
            total = np.add.reduceat(value, new)
            node = target[lo:hi][new]
            alpha[node] = top + np.log(total)
            running = np.cumsum(value)
            before = running[new] - value[new]
            share[lo:hi] = (running - np.repeat(before, count)) / np.repeat(total, count)
            share[lo + new + count - 1] = 2.0  # the last edge always takes
            begin[node] = lo + new
        if tail < len(steps):
            self._forward_few(int(steps[tail]), source, target, weight, alpha, share, begin)
        return source, piece, share, begin

    @staticmethod
    def _forward_few(lo: int, source, target, weight, alpha, share, begin):
        """The same for the edges from ``lo`` on, one node after the other."""
        new: dict[int, float] = {}
        while lo < len(source):
            hi = min(lo + (1 << 16), len(source))
            while hi < len(source) and target[hi] == target[hi - 1]:
                hi += 1
            src, tgt, wgt = source[lo:hi].tolist(), target[lo:hi].tolist(), weight[lo:hi].tolist()
            found, starts, nodes, k = [], [], [], 0
            while k < len(src):
                node, first = tgt[k], k
                values = []
                while k < len(src) and tgt[k] == node:
                    values.append((new[src[k]] if src[k] in new else float(alpha[src[k]])) + wgt[k])
                    k += 1
                top = max(values)
                parts = [exp(v - top) for v in values]
                total, running = sum(parts), 0.0
                new[node] = top + log(total)
                for x in parts:
                    running += x
                    found.append(running / total)
                found[-1] = 2.0
                starts.append(lo + first)
                nodes.append(node)
            share[lo:hi] = found
            begin[nodes] = starts
            lo = hi

    def _backward(self, raw, edges, first_node, size, chunk, text_of, base, n_texts):
        source, piece, share, begin = edges
        node, floor = (first_node + size)[chunk], first_node[chunk]
        who = np.arange(len(chunk))
        drawn = []
        step = np.zeros(len(chunk), np.int64)
        turn = 0
        while len(who) > FEW_WALKS:
            u = _draws(base[who] + np.uint64(turn))
            edge = begin[node[who]]
            more = np.flatnonzero(share[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[share[edge[more]] <= u[more]]
            drawn.append((who, edge))
            step[who] += 1
            node[who] = source[edge]
            who = who[node[who] > floor[who]]
            turn += 1
        ends = {}
        for w in who.tolist():
            ends[w] = np.array(_walk(int(node[w]), int(floor[w]), base[w], turn, source, share, begin), np.int64)
            step[w] += len(ends[w])
        last = np.cumsum(step) - 1
        path = np.empty(int(step.sum()), np.int64)
        for k, (who, edge) in enumerate(drawn):
            path[last[who] - k] = edge
        for w, edge in ends.items():
            path[last[w] - turn - np.arange(len(edge))] = edge
        owner = np.repeat(text_of, step)
        ids = piece[path]
        spelled = np.flatnonzero(ids < 0)
        if len(spelled):
            # A byte piece for each byte of the characters without a piece.
            chunk_of = np.repeat(chunk, step)[spelled]
            char = raw[source[path[spelled]] - chunk_of]
            letters, at = np.unique(char, return_inverse=True)
            bytes_of = [chr(int(c)).encode("utf-8", "surrogatepass") for c in letters]
            count = np.ones(len(ids), np.int64)
            count[spelled] = np.array([len(b) for b in bytes_of])[at]
            ids, owner = np.repeat(ids, count), np.repeat(owner, count)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(bytes_of[k] for k in at.tolist()), np.uint8)]
        return ids.astype(np.int32), np.bincount(owner, minlength=n_texts)


def _draws(h: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), one for each hash."""
    return (mix(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _walk(node: int, floor: int, base: np.uint64, turn: int, source, share, begin) -> list[int]:
    """The edges from ``node`` back to ``floor``, drawn one after the other."""
    out: list[int] = []
    draws: list[float] = []
    k = 0
    while node > floor:
        if k == len(draws):
            draws, k = _draws(base + np.arange(turn, turn + 4096, dtype=np.uint64)).tolist(), 0
            turn += 4096
        edge = int(begin[node])
        while share[edge] <= draws[k]:
            edge += 1
        out.append(edge)
        node, k = int(source[edge]), k + 1
    return out


@lru_cache(2)
def load_pieces(path: str, alpha: float = ALPHA) -> Pieces:
    """One vocabulary per worker and file."""
    return Pieces(path, alpha)


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(repr(key).encode(), seed=seed)


def encode(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n_ids, lossless)`` per row.

    ``lossless``: the ids, decoded, are the text again.  A null text has null
    ids, an empty one none; both count 0 and are lossless.  Rows with the same
    id and text, repeated ones too, get the same ids; null ids share a seed.
    Other columns are not read.  Whole texts are segmented, without a shuffle,
    ``BATCH_CHARS`` characters at a time, long texts in stretches.  Beside the
    batch and the ids of ``ROWS_IN`` rows memory holds one stretch's lattice; a
    stretch is longer only where a text has neither a blank nor a place that no
    piece spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(load_pieces(model_path, alpha), batches, seed)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>, n_ids long, lossless boolean")


def encoded_batches(pieces: Pieces, batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """The result for batches of ids and texts."""
    for batch in (b.slice(lo, ROWS_IN) for b in batches for lo in range(0, b.num_rows, ROWS_IN)):
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids: list[np.ndarray] = []
        done, same, count = 0, np.ones(len(texts), bool), np.zeros(len(texts), np.int64)
        for rows, some, places in _stretches(texts):
            seeds = np.array([row_seed(keys[k], seed) for k in rows], np.uint64)
            flat, n = pieces.sample(some, seeds, np.array(places, np.int64))
            offset, plain = np.concatenate([[0], np.cumsum(n)]), flat.tolist()
            for a, b, k, t in zip(offset[:-1].tolist(), offset[1:].tolist(), rows, some):
                same[k] &= pieces.decode(plain[a:b]) == t if t is not None else True
            np.add.at(count, rows, n)
            ids.append(flat)
            # All rows before the stretch's last one are complete.
            if rows[-1] - done >= ROWS_OUT:
                last = rows[-1]
                rest = int(count[last])
                flat = np.concatenate(ids)
                yield _encoded(batch, done, last, flat[: len(flat) - rest], count, same, texts)
                done, ids = last, [flat[len(flat) - rest :]]
        yield _encoded(batch, done, len(texts), np.concatenate([np.empty(0, np.int32), *ids]), count, same, texts)


def _encoded(batch: pa.RecordBatch, lo: int, hi: int, flat: np.ndarray, count: np.ndarray, same: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
    """Rows ``lo`` to ``hi`` with their ids."""
    offset, null = np.concatenate([[0], np.cumsum(count[lo:hi])]), pa.array([t is None for t in texts[lo:hi]], pa.bool_())
    return pa.RecordBatch.from_arrays([
        batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(flat, pa.int32()), mask=null),
        pa.array(count[lo:hi], pa.int64()), pa.array(same[lo:hi], pa.bool_())], names=["doc_id", "ids", "n_ids", "lossless"])


def _stretches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str | None], list[int]]]:
    """Rows, stretches of their texts between blanks, and the number of each
    one's first chunk, about ``BATCH_CHARS`` characters at a time."""
    rows, some, places, size = [], [], [], 0
    for k, text in enumerate(texts):
        lo, place = 0, 0
        while True:
            at = text.find(" ", lo + BATCH_CHARS) if text and len(text) - lo > BATCH_CHARS else -1
            part = text[lo:at] if at >= 0 else text[lo:] if text else None
            if size and size + len(part or "") > BATCH_CHARS:
                yield rows, some, places
                rows, some, places, size = [], [], [], 0
            rows.append(k)
            some.append(part)
            places.append(place)
            size += len(part or "")
            if at < 0:
                break
            lo, place = at + 1, place + part.count(" ") + 1
    if rows:
        yield rows, some, places


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """All columns of ``encoded`` and the text of each row's ids."""

    @F.pandas_udf("string")
    def text(ids):  # noqa: ANN001, ANN202
        pieces = load_pieces(model_path)
        return ids.map(lambda x: None if x is None else pieces.decode(list(x)))

    return encoded.withColumn(out_col, text(F.col(ids_col)))

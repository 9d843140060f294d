"""Training-order materialisation of token sequences.

Texts become token ids, packed end to end into sequences of one length.  A
keyed Feistel permutation with cycle-walking gives every sequence its slot in
the training order: no shuffle buffer, no table of the order, and the inverse
can be computed.  Slots are dealt by ranges, one task a shard; each shard is
one file of fixed-stride records, so that a reader finds any slot by
arithmetic, reads on from there, and resumes anywhere.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import as_table, pinned, qualified, shared_path, stage_table, unstage
from skein.llm.parts import PartStore, groups

SEQ_TOKENS = 1024
#: Bytes of a record: ids are unsigned 16-bit, little endian.
STRIDE = 2 * SEQ_TOKENS
SHARD_SEQS = 8_192
#: Splits whose places are broadcast, at most.
MAX_SPLITS = 4_000_000
ROUNDS = 6

_ENCODINGS: dict[str, object] = {}


def load_encoding(path: str, pattern: str):
    """A ``.tiktoken`` rank file, one encoding per worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("skein", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of ``range(n)``."""

    n: int
    key: int

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round(self, right: np.ndarray, k: int) -> np.ndarray:
        mult = np.uint64(xxhash.xxh3_64_intdigest(f"{self.key}/{k}".encode()) | 1)
        h = (right + np.uint64(k + 1)) * mult
        h ^= h >> np.uint64(29)
        h *= mult
        return (h >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for k in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ self._round(left, k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), inverse)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], inverse)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


_FRAGMENT = "slot long, shard int, at int, ids binary"
_MANIFEST = "slot long, shard int, offset long, seq long, n_tokens int, crc32 long"


def _ids(store: PartStore, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
    """Ids of the texts, each ended by ``end_id``, a bounded stretch at a time."""
    for _, some, ends in groups(texts):
        parts = store.of(some)
        n = np.array([len(v) // 2 for v in parts.values], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(parts.values), np.uint16)))
        flat = lists.take(pa.array(parts.index)).flatten().to_numpy()
        yield np.insert(flat, np.cumsum(parts.sums(n))[np.array(ends)], end_id)


def _count(ranks_path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens of each run of rows, end marks included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(ranks_path, pattern).encode_ordinary
        store, totals = PartStore(lambda new: [len(encode(p)) for p in new]), {}
        for batch in batches:
            texts, found = batch.column(2).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for numbers, some, ends in groups(texts):
                parts = store.of(some)
                np.add.at(found, numbers, parts.sums(np.array(parts.values, np.int64)) + np.array(ends))
            for k, n in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), found.tolist()):
                totals[k] = totals.get(k, 0) + n
        paths, starts = zip(*totals) if totals else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(totals.values(), pa.int64())], names=["path", "start", "n"])

    return run


def _cut(order: Feistel, ranks_path: str, pattern: str, end_id: int, seq_tokens: int, shard_seqs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each run of rows gives to the sequences that it reaches into."""

    def fragments(pos: int, data: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        seq, at = np.divmod(pos + edges[:-1], seq_tokens)
        slot = order.slot(seq)
        ids = [data[a:b].astype("<u2").tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return pa.RecordBatch.from_arrays([
            pa.array(slot), pa.array(slot // shard_seqs, pa.int32()), pa.array(at, pa.int32()), pa.array(ids, pa.binary())], names=["slot", "shard", "at", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(ranks_path, pattern).encode_ordinary
        store = PartStore(lambda new: [array("H", encode(p)).tobytes() for p in new])
        none = np.zeros(0, np.uint16)
        current, pos, left = None, 0, none
        for batch in batches:
            runs, before = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for lo, hi in zip(edges[:-1], edges[1:]) if len(runs) else ():
                if runs[lo] != current:
                    if len(left):
                        yield fragments(pos, left, np.array([0, len(left)]))
                    current, pos, left = runs[lo], int(before[lo]), none
                for data in _ids(store, batch.column(2).slice(lo, hi - lo).to_pylist(), end_id):
                    data = np.concatenate([left, data])
                    cuts = np.arange(seq_tokens - pos % seq_tokens, len(data) + 1, seq_tokens)
                    if len(cuts):
                        yield fragments(pos, data, np.concatenate([[0], cuts]))
                        data, pos = data[cuts[-1] :], pos + int(cuts[-1])
                    left = data
        if len(left):
            yield fragments(pos, left, np.array([0, len(left)]))

    return run


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(uri: str, order: Feistel, end_id: int, seq_tokens: int, shard_seqs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write sorted fragments as the records of their shards."""
    stride = 2 * seq_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(uri)
        done: list[tuple] = []
        shard, out, temp, nxt, slot, record = None, None, "", 0, None, bytearray()

        def close() -> None:
            if out is not None:
                if nxt != min(order.n, (shard + 1) * shard_seqs):
                    raise ValueError(f"shard {shard} ends before slot {nxt}: fragments are missing")
                out.close()
                store.move(temp, f"{root}/shard-{shard:06d}.bin")

        def flush() -> None:
            nonlocal nxt
            if slot is None:
                return
            n = len(record) // 2
            if slot != nxt or n < seq_tokens and order.index(np.array([slot]))[0] != order.n - 1:
                raise ValueError(f"slot {slot} is incomplete: fragments are missing")
            record.extend(np.full(seq_tokens - n, end_id, "<u2").tobytes())
            out.write(record)
            done.append((slot, shard, slot % shard_seqs * stride, n, zlib.crc32(record)))
            nxt += 1

        def manifest() -> pa.RecordBatch:
            slots, shards, offsets, n, crc = zip(*done) if done else ((),) * 5
            seq = order.index(np.array(slots, np.int64)) if done else ()
            columns = zip((slots, shards, offsets, seq, n, crc), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["slot", "shard", "offset", "seq", "n_tokens", "crc32"])

        for batch in batches:
            for s, k, at, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if s != slot:
                    flush()
                    slot, record = s, bytearray()
                    if k != shard:
                        close()
                        shard, nxt, temp = k, k * shard_seqs, f"{root}/.shard-{k:06d}-{uuid.uuid4().hex}"
                        out = store.open_output_stream(temp)
                if 2 * at != len(record):
                    raise ValueError(f"slot {s}: a fragment of place {at} follows {len(record) // 2} tokens")
                record += ids
            yield manifest()
            done.clear()
        flush()
        close()
        yield manifest()

    return run


def materialise(docs: DataFrame, path: str, ranks_path: str, pattern: str, end_id: int, key: int = 0,
                seq_tokens: int = SEQ_TOKENS, shard_seqs: int = SHARD_SEQS, text_col: str = "text") -> DataFrame:
    """Write the shards under ``path``; return a manifest row per sequence.

    ``(slot, shard, offset, seq, n_tokens, crc32)``: the record of ``slot``
    begins at byte ``offset`` of ``shard-<shard>.bin`` and holds sequence
    ``seq`` of the token stream.  Every slot from 0 to the number of sequences
    less 1 is used once.

    The stream is the table's rows in the order of its files, each text ended
    by ``end_id``; so it depends on the table and the key, and not on how the
    table is split or on which machine reads what.  Rows that are not read from
    files as they are get a table in the shared folder first.  The last
    sequence is filled up with ``end_id``; ``n_tokens`` counts what is real.

    Null texts are left out; an empty text is an end mark alone; repeated rows
    are packed each; other columns are not read; an empty table writes nothing.
    Ids must fit 16 bits.

    Two passes tokenise: the first one gives every split its place in the
    stream, the second cuts the splits where sequences begin and sends the
    fragments straight to their shard, each shard one task.  Nothing else is
    shuffled or staged.  Each split's place is broadcast: 16 bytes for each
    split of ``spark.sql.files.maxPartitionBytes``, 13 MB for 100 TB in splits
    of 128 MB.  Beyond ``MAX_SPLITS`` the table is rewritten to larger files.
    A shard is written under a name of the attempt, then renamed, so a task
    that runs again replaces the file by an equal one.
    """
    spark = docs.sparkSession
    uri = qualified(spark, path)
    table, staged = as_table(docs.select(text_col), "texts"), []
    if hasattr(table, "staged_path"):
        staged.append(table)
    # Both passes must split alike, also if executors come or go in between.
    cores = spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)
    with pinned(spark, spark__sql__files__minPartitionNum=cores):
        while True:
            at = table.metadataColumn("_metadata")
            rows = table.select(at["file_path"].alias("path"), at["file_block_start"].alias("start"), F.col(text_col).cast("string").alias("text"))
            counted = rows.mapInArrow(_count(ranks_path, pattern), "path string, start long, n long").groupBy("path", "start").agg(F.sum("n").alias("n"))
            runs = stage_table(counted.withColumn("run", F.xxhash64("path", "start")), "splits")
            staged.append(runs)
            n_runs, n_names, total = runs.agg(F.count("*"), F.count_distinct("run"), F.coalesce(F.sum("n"), F.lit(0))).first()
            if n_names < n_runs:
                raise ValueError("two splits share a hash")
            if n_runs <= MAX_SPLITS or any(table is x for x in staged):
                break
            staged.append(table := stage_table(table.coalesce(MAX_SPLITS // 8), "texts", compression="zstd"))
        if not total:
            return spark.createDataFrame([], _MANIFEST)
        n_seqs = -(-total // seq_tokens)
        n_shards, order = -(-n_seqs // shard_seqs), Feistel(n_seqs, key)
        before = F.sum("n").over(Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1))
        places = runs.select("run", F.coalesce(before, F.lit(0)).alias("before"))
        keyed = rows.select(F.xxhash64("path", "start").alias("run"), "text").join(F.broadcast(places), "run").select("run", "before", "text")
        cut = keyed.mapInArrow(_cut(order, ranks_path, pattern, end_id, seq_tokens, shard_seqs), _FRAGMENT)
        store, root = _store(uri)
        store.create_dir(root, recursive=True)
        dealt = cut.repartitionById(n_shards, "shard").sortWithinPartitions("slot", "at")
        manifest = stage_table(dealt.mapInArrow(_write(uri, order, end_id, seq_tokens, shard_seqs), _MANIFEST), "manifest")
    for f in store.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith(".shard-"):
            store.delete_file(f.path)
    unstage(*staged)
    return manifest


class ShardReader:
    """Sequential, resumable reads of materialised sequences by slot."""

    def __init__(self, path: str, n_slots: int, seq_tokens: int = SEQ_TOKENS, shard_seqs: int = SHARD_SEQS):
        self.store, self.root = _store(path) if ":/" in path else (pafs.LocalFileSystem(), path)
        self.n_slots, self.stride, self.shard_seqs = n_slots, 2 * seq_tokens, shard_seqs

    def read(self, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """``(slot, ids)`` from ``start`` on; pass the next slot to resume.

        A shard that ends before its last slot raises EOFError."""
        slot = start
        while slot < self.n_slots:
            shard, end = slot // self.shard_seqs, min(self.n_slots, (slot // self.shard_seqs + 1) * self.shard_seqs)
            with self.store.open_input_file(f"{self.root}/shard-{shard:06d}.bin") as f:
                f.seek(slot % self.shard_seqs * self.stride)
                while slot < end:
                    data = f.read(self.stride)
                    if len(data) < self.stride:
                        raise EOFError(f"shard {shard} ends before slot {slot}")
                    yield slot, np.frombuffer(data, "<u2")
                    slot += 1


def order_in_shared_folder(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, key: int = 0) -> DataFrame:
    """``materialise`` under a fresh folder of the shared one."""
    spark: SparkSession = docs.sparkSession
    return materialise(docs, shared_path(spark, "ordered"), ranks_path, pattern, end_id, key)

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells.  Each shard owns several virtual nodes
on cell boundaries, and a key belongs to the first virtual node clockwise from
its cell.  A shard holds exactly its share of the rows: those that overflow it
continue clockwise to the next virtual node whose shard has room.  So balance
is guaranteed, and rows leave their home shard only where it is full.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import stage_table

LG_CELLS = 16
VNODES = 128
#: Bits of the hash that orders a cell's rows.
ORDER_BITS = 31
#: Distinct rows that are ranked together, and copies that are dealt together.
PART_ROWS, COPY_ROWS = 1 << 19, 1 << 14


def owners(n_shards: int, vnodes: int = VNODES) -> np.ndarray:
    """Home shard of each cell: the owner of the next virtual node clockwise."""
    cells = 1 << LG_CELLS
    points = sorted((xxhash.xxh3_64_intdigest(f"{s}/{v}".encode()) >> (64 - LG_CELLS), s, v) for s in range(n_shards) for v in range(vnodes))
    at = np.searchsorted([p[0] for p in points], np.arange(cells), side="left") % len(points)
    return np.array([p[1] for p in points])[at]


@dataclass
class Run:
    """Rows ``lo`` to ``hi`` of a cell go to ``shard``, from slot ``base``."""

    cell: int
    lo: int
    hi: int
    shard: int
    base: int


def place(counts: np.ndarray, n_shards: int, vnodes: int = VNODES) -> list[Run]:
    """Bounded-load placement of cells with the given row counts.

    The first ``total % n_shards`` shards hold one row more than the others.
    Home rows are taken in ring order up to the share; then what overflowed
    goes on clockwise, in ring order.
    """
    home, total = owners(n_shards, vnodes), int(counts.sum())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    pieces: list[tuple[int, int, int, int]] = []
    over: list[tuple[int, int]] = []
    for c in np.flatnonzero(counts).tolist():
        s, n = int(home[c]), int(counts[c])
        took = min(n, room[s])
        room[s] -= took
        if took:
            pieces.append((c, 0, took, s))
        if took < n:
            over.append((c, took))
    starts = np.flatnonzero(np.diff(home, prepend=home[-1])).tolist() or [0]
    for c, lo in over:
        n, k = int(counts[c]), int(np.searchsorted(starts, c, side="right"))
        while lo < n:
            s = int(home[starts[k % len(starts)]])
            took = min(n - lo, room[s])
            if took:
                room[s] -= took
                pieces.append((c, lo, lo + took, s))
                lo += took
            k += 1
    used, out = [0] * n_shards, []
    for c, lo, hi, s in sorted(pieces):
        out.append(Run(c, lo, hi, s, used[s]))
        used[s] += hi - lo
    return out


def shard(docs: DataFrame, n_shards: int = 8, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text",
          part_rows: int = PART_ROWS, copy_rows: int = COPY_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row.

    The law held is ``rows``: shard counts are at most one apart.  Slots are
    gapless from 0 in each shard.  A null text has size 1 and crc 0; a null id
    has a place on the ring of its own.  Rows that are alike in id, size and
    crc are counted together and take neighbouring slots.  Within a cell, rows
    are in the order of a hash of those three; so the placement depends on the
    rows only.  Other columns are not read.  An empty table gives no rows.

    A cell's order is cut at fixed shares of the hash range into parts of about
    ``part_rows`` rows, which are ranked apart and put together by their
    counts; a cell that one id fills is many parts, and copies of one row are
    spread after they were counted.  The driver gets one count for each of
    2 ** 16 cells; the runs that it sends back have the same bound, which is
    why they are broadcast.
    """
    spark, cells = docs.sparkSession, 1 << LG_CELLS
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    alike = stage_table(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).select(
        "*", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("ring")), 64 - LG_CELLS).cast("int").alias("cell"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32", F.lit("order")), 64 - ORDER_BITS).alias("at")), "sizes")
    counts, distinct = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in alike.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():
        counts[r["cell"]], distinct[r["cell"]] = r["n"], r["d"]
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in place(counts, n_shards, vnodes):
        runs.setdefault(r.cell, []).append((r.lo, r.hi, r.shard, r.base))
    run = T.StructType([T.StructField(k, T.LongType()) for k in ("lo", "hi", "shard", "base")])
    plan = spark.createDataFrame(
        [(c, int(-(-distinct[c] // part_rows)), x) for c, x in runs.items()],
        T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("parts", T.LongType()), T.StructField("runs", T.ArrayType(run))]))
    dealt = alike.join(F.broadcast(plan), "cell").withColumn("part", F.shiftright(F.col("at") * F.col("parts"), ORDER_BITS))
    of_part = dealt.groupBy("cell", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.select("cell", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("cell", "part").orderBy("at", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(of_part, ["cell", "part"])
    first = F.col("before") + F.col("inside")
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {copy_rows}")))
    spread = lambda df: df.withColumn("rank", F.explode(F.sequence("first", "last")))
    ranked = ranked.withColumn("first", first).withColumn("last", F.col("first") + F.col("n") - 1)
    if alike.where(F.col("n") > copy_rows).take(1):
        few, many = ranked.where(F.col("n") <= copy_rows), ranked.where(F.col("n") > copy_rows).withColumn("chunk", chunk)
        many = many.withColumn("first", F.col("first") + F.col("chunk") * copy_rows).withColumn("last", F.least("last", F.col("first") + copy_rows - 1))
        ranked = spread(few).unionByName(spread(many.repartition(F.xxhash64("cell", "chunk"))).drop("chunk"))
    else:
        ranked = spread(ranked)
    mine = F.filter("runs", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0]
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), mine["shard"].cast("int").alias("shard"),
        (mine["base"] + F.col("rank") - mine["lo"]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

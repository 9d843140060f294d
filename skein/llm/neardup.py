"""Near-duplicate detection by a chosen-path set similarity join.

Documents with the same shingle set form a class; classes are what is joined.
Each of several independent trees branches the classes by minwise tokens: a
node's children are named by a chosen coordinate of the MinHash signature and
its value.  Nodes of up to ``NODE`` classes are compared exhaustively; larger
ones branch again, by two fresh coordinates.  A node that is still large at the
last level is mostly one big group, which comparing takes linear time for; only
what one task can't hold is compared in blocks.  A pair of similarity s gets
through the root of a tree with probability s and through each further level
with 1-(1-s)^2, so ``TREES`` trees find a pair of similarity 0.75 with
probability above 1-1e-7 at the roots and 1-1e-5 down to the last level.

A node proposes groups: classes whose signatures agree, each around its
smallest id, the hub.  Groups of one hub are united over all trees, their texts
are fetched once a hub, and links are confirmed on full shingle sets.  A group
too large for one task goes in blocks, the hub in each; members that are in the
hub's component by then need no further comparison with one another, so only
the others meet all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import address, arrow_map, as_table, components, map_batches, mix, stage_table, unstage, utf8, window_hashes, word_hashes

SHINGLE = 5
#: Links have 100 * intersection >= LINK * union.
LINK = 75
#: Coordinates of a signature, one byte each, and how many must agree for a
#: pair to be checked on full sets: five standard deviations below 0.75.
COORDS, AGREE = 64, 30
TREES, LEVELS = 12, 3
#: Classes of a node that does not branch, and of one that a task compares.
NODE, LARGEST = 64, 16_384
#: Times that groups are merged into groups with smaller hubs.
JUMPS = 2
#: Shingles of a group that is confirmed at once; larger groups are confirmed
#: in blocks of half as many.
GROUP_SHINGLES = 3_000_000

_A = np.array([xxhash.xxh3_64_intdigest(b"coordinate", seed=k) | 1 for k in range(COORDS)], np.uint64)


def shingle_set(data: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased (A-Z) 5-word shingles."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(SHINGLE, len(words))))


def minima(s: np.ndarray) -> np.ndarray:
    """Hash of the minimum under each of ``COORDS`` hash functions."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 4096):
        np.minimum(low, (s[lo : lo + 4096][None, :] * _A[:, None]).min(axis=1), out=low)
    return mix(low)


def signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """One byte of each minimum, and whole minima for the trees' roots."""
    low = minima(s)
    return (low >> np.uint64(56)).astype(np.uint8).tobytes(), low[:TREES].tobytes()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Groups of rows with equal first column, from sorted batches."""
    names, group = [], []
    for batch in batches:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        keys = columns[0]
        lo = 0
        while lo < len(keys):
            hi = lo
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if group and group[0][0] != keys[lo]:
                yield dict(zip(names, group))
                group = []
            part = [c[lo:hi] for c in columns]
            group = [a + b for a, b in zip(group, part)] if group else part
            lo = hi
    if group:
        yield dict(zip(names, group))


def _by_group(rows: DataFrame, fn: Callable[[dict[str, list]], list[tuple]], out: dict[str, pa.DataType]) -> DataFrame:
    """Rows that ``fn`` makes of each group of the first column."""
    key = rows.columns[0]
    schema = ", ".join(f"{k} {'binary' if pa.types.is_binary(t) else 'long'}" for k, t in out.items())

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [()] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.values())], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for group in _runs(batches):
            if len(group[key]) > 1:
                found += fn(group)
            if len(found) > 50_000:
                yield batch(found)
                found = []
        yield batch(found)

    return map_batches(rows.repartition(key).sortWithinPartitions(key), run, schema)


def _stars(ids: list[bytes], label: np.ndarray) -> list[tuple[bytes, bytes]]:
    """``(member, smallest id)`` of each label with two members or more."""
    order = np.argsort(label, kind="stable")
    edges = np.flatnonzero(np.diff(label[order])) + 1
    out = []
    for part in np.split(order, edges):
        if len(part) > 1:
            names = [ids[k] for k in part.tolist()]
            hub = min(names)
            out += [(x, hub) for x in names]
    return out


def propose(group: dict[str, list]) -> list[tuple[bytes, bytes, int]]:
    """``(member, hub, shingles)`` of the classes whose signatures agree."""
    known = {x: (s, n) for x, s, n in zip(group["id"], group["sig"], group["n"])}
    ids = sorted(known)
    if len(ids) < 2:
        return []
    s = np.frombuffer(b"".join(known[x][0] for x in ids), np.uint8).reshape(len(ids), COORDS)
    label = np.arange(len(ids))
    for i in range(len(ids) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(other):
            near = other[np.count_nonzero(s[other] == s[i], axis=1) >= AGREE]
            for k in np.unique(label[near]).tolist():
                label[label == k] = label[i]
    return [(x, hub, known[x][1]) for x, hub in _stars(ids, label)]


def confirm(group: dict[str, list]) -> list[tuple[bytes, bytes]]:
    """Exact links among a group's members, as stars of linear size."""
    sets: dict[bytes, np.ndarray] = {}
    for name, data in zip(group["id"], group["text"]):
        if name not in sets:
            s = shingle_set(data)
            if xxhash.xxh3_128_digest(s.tobytes()) == name:
                sets[name] = s
    ids = sorted(sets)
    return _stars(ids, label_linked([sets[x] for x in ids])) if len(ids) > 1 else []


def _linked(both, a, b):  # noqa: ANN001, ANN202
    return 100 * both >= LINK * (a + b - both)


class _Postings:
    """Which of some sets hold each shingle."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members = members
        keys = np.concatenate([sets[k] for k in members.tolist()])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner = np.repeat(np.arange(len(members)), [len(sets[k]) for k in members.tolist()])[order]

    def shared(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets that share shingles with ``s``, and how many."""
        lo, hi = np.searchsorted(self.keys, s), np.searchsorted(self.keys, s, side="right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = self.owner[at]
        if len(owner) * 8 < len(self.members):
            some, both = np.unique(owner, return_counts=True)
        else:
            both = np.bincount(owner, minlength=len(self.members))
            some = np.flatnonzero(both)
            both = both[some]
        return self.members[some], both


def label_linked(sets: list[np.ndarray]) -> np.ndarray:
    """Component of each set, by the first set in it.

    Every set is intersected, through an index of shingles, with those that are
    in no component yet; a group of near copies takes one pass."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([0, 0 if _linked(both, size[0], size[1]) else 1])
    label, left = np.full(len(sets), -1), len(sets)
    index = _Postings(sets, np.arange(len(sets)))
    for i in range(len(sets)):
        if label[i] >= 0:
            continue
        label[i], queue, left = i, [i], left - 1
        while queue and left:
            x = queue.pop()
            others, both = index.shared(sets[x])
            new = others[(label[others] < 0) & _linked(both, size[x], size[others])]
            label[new] = i
            queue += new.tolist()
            left -= len(new)
            if left and 2 * left < len(index.members):
                index = _Postings(sets, np.flatnonzero(label < 0))
    return label


_NODE_ROW = "key long, id binary, sig binary, n long"


def _children(level: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Branch rows ``(key, id, sig, n)``; at the root, a child for each tree."""

    def branch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        at = {x: batch.column(k) for k, x in enumerate(batch.schema.names)}
        if level == 0:
            roots = np.frombuffer(b"".join(at["roots"].to_pylist()), np.uint64).reshape(n, TREES)
            keys = [mix(roots[:, t] + np.uint64(t + 1)) for t in range(TREES)]
        else:
            sig = np.frombuffer(b"".join(at["sig"].to_pylist()), np.uint8).reshape(n, COORDS).astype(np.uint64)
            key = at["key"].to_numpy().view(np.uint64)
            # The node's own hash chooses its coordinates, alike for all rows.
            chosen = [(mix(key + np.uint64(101 * level + j)) % np.uint64(COORDS)).astype(np.int64) for j in range(2)]
            chosen[1] = np.where(chosen[0] == chosen[1], (chosen[1] + 1) % COORDS, chosen[1])
            keys = [mix(key * _A[level] + c.astype(np.uint64) * np.uint64(257) + sig[np.arange(n), c]) for c in chosen]
        same = [pa.concat_arrays([at[x]] * len(keys)) for x in ("id", "sig", "n")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *same], names=["key", "id", "sig", "n"])

    return branch


def nodes(classes: DataFrame, node: int = NODE, largest: int = LARGEST, levels: int = LEVELS) -> list[DataFrame]:
    """Rows ``(key, id, sig, n)`` of all nodes that are compared, level by level.

    Sizes are counted before anything is brought together, so a node that is
    too large never meets in one task.
    """
    found, rows = [], arrow_map(classes.select("id", "sig", "roots", "n"), _children(0), _NODE_ROW)
    for level in range(1, levels + 1):
        most = node if level < levels else largest
        large = stage_table(rows.groupBy("key").count().where(F.col("count") > most), "large-nodes")
        if not large.take(1):
            return [*found, rows]
        found.append(rows.join(large, "key", "left_anti"))
        if level < levels:
            rest = rows.join(large, "key", "left_semi")
            rows = stage_table(arrow_map(rest, _children(level), _NODE_ROW).dropDuplicates(["key", "id"]), "branches")
    # Still large: all pairs of blocks of half a node.
    mine = rows.join(large, "key").withColumn("blocks", F.ceil(F.col("count") * 2 / largest).cast("int"))
    mine = mine.withColumn("mine", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return [*found, pairs.select(key.alias("key"), "id", "sig", "n")]


def merged(groups: DataFrame) -> DataFrame:
    """Groups (id, hub, n) whose hub is a member of groups with smaller hubs, as
    part of the smallest of those.  Leaves of one big group have hubs of their
    own; followed ``JUMPS`` times, they are one again and so are its texts."""
    for _ in range(JUMPS):
        hubs = groups.select("hub").distinct()
        to = groups.join(hubs.select(F.col("hub").alias("id")), "id", "left_semi").groupBy("id").agg(F.min("hub").alias("to"))
        to = stage_table(to.where("to != id").select(F.col("id").alias("hub"), "to"), "smaller-hubs")
        if not to.take(1):
            return groups
        before, groups = groups, stage_table(groups.join(to, "hub", "left").select("id", F.coalesce("to", "hub").alias("hub"), "n").distinct(), "groups")
        unstage(before, to)
    return groups


def confirmed(groups: DataFrame, texts: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Links ``(a, b)`` of ``groups`` (hub, id, n) by ``texts`` (id, text).

    Each text is copied once for a group, but for members of a large group
    that are not linked to its hub's component: they meet all its blocks.
    """
    sizes = groups.groupBy("hub").agg(F.sum("n").alias("shingles")).where(F.col("shingles") > group_shingles)
    large = stage_table(sizes.select("hub", F.ceil(F.col("shingles") * 2 / group_shingles).cast("int").alias("blocks")), "large-groups")
    link = {"a": pa.binary(), "b": pa.binary()}
    if not large.take(1):
        return _by_group(groups.select(F.xxhash64("hub").alias("grp"), "id").join(texts, "id").select("grp", "id", "text"), confirm, link)
    placed = groups.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "hub"), F.col("blocks")).cast("int"))
    hubs = placed.where("id = hub and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    once = placed.unionByName(hubs).select(F.xxhash64("hub", "block").alias("grp"), "id").distinct()
    links = stage_table(_by_group(once.join(texts, "id").select("grp", "id", "text"), confirm, link), "links")
    parts = placed.where("blocks > 1").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = stage_table(parts.select("hub", "id", "n", "block", "blocks", "component"), "large-members")
    of_hub = parts.where("id = hub").select("hub", F.col("component").alias("hubs"))
    others = stage_table(parts.join(of_hub, "hub").where("component != hubs").select("hub", "id", "n", "blocks"), "unlinked")
    some = others.groupBy("hub").agg(F.ceil(F.sum("n") * 2 / group_shingles).cast("int").alias("lots"))
    unlinked = others.join(some, "hub").withColumn("lot", F.pmod(F.xxhash64("id", "hub", F.lit("lot")), F.col("lots")).cast("int"))
    unlinked = unlinked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", "lot", "block", "id")
    every = parts.join(some, "hub").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("hub", "lot", "block", "id")
    met = unlinked.unionByName(every).select(F.xxhash64("hub", "lot", "block").alias("grp"), "id").distinct()
    return links.unionByName(_by_group(met.join(texts, "id").select("grp", "id", "text"), confirm, link))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node: int = NODE, largest: int = LARGEST,
                    group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, component, file, place)`` for
    every row; ``file`` and ``place`` are its address (see ``common.address``)
    in ``docs``, or in a staged copy if ``docs`` is not a table.

    Null texts and texts without words have no shingles, are linked with
    nothing, are kept, and have a null ``component``, which names the group
    otherwise.  Fewer than five words make one shingle.  ``component_id`` is
    the smallest doc_id in the group; null ids are never smallest, and rows
    whose group has no other are kept.  Repeated rows are in one group and
    those with its id are all kept.  Other columns are not read, whatever their
    names.
    """

    def profile(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, sigs = [], [], []
        for data in utf8(batch, "text"):
            s = shingle_set(data)
            n.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s) if len(s) else (None, None))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), *(pa.array([x[k] for x in sigs], pa.binary()) for k in (0, 1))],
            names=["doc_id", "file", "place", "n_shingles", "id", "sig", "roots"])

    table = as_table(docs.select(*dict.fromkeys((id_col, text_col))))
    texts = table.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *address(table))
    rows = stage_table(arrow_map(texts, profile, "doc_id long, file long, place long, n_shingles long, id binary, sig binary, roots binary"), "profiles")
    # Rows of one class are alike but for where their text is.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "file", "place", "sig", "roots", "n_shingles")).alias("row")
    classes = stage_table(rows.where("id is not null").groupBy("id").agg(first).select(
        "id", "row.doc_id", "row.file", "row.place", "row.sig", "row.roots", F.col("row.n_shingles").alias("n")), "classes")

    member = {"id": pa.binary(), "hub": pa.binary(), "n": pa.int64()}
    found = [_by_group(x, propose, member) for x in nodes(classes, node, largest)]
    groups = merged(stage_table(reduce(DataFrame.unionByName, found).distinct(), "groups"))
    wanted = groups.select("id").distinct().join(classes.select("id", "file", "place"), "id")
    candidates = stage_table(
        texts.select("file", "place", "text").join(wanted, ["file", "place"]).select("id", F.col("text").cast("binary").alias("text")), "candidates")
    linked = components(confirmed(groups, candidates, group_shingles))
    labelled = classes.select("id", "doc_id").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage_table(labelled.join(least, "component").select("id", "component", "component_id"), "components")
    unstage(classes, groups, candidates)
    component_id = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", "n_shingles", "id", "file", "place").join(named, "id", "left").withColumn("component_id", component_id)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component", "file", "place")

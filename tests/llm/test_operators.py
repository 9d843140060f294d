"""Each operator against a plain computation of the same thing, and odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import accumulate, combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import common, decontam, langid, linespread, neardup, order, parts, pieces, quality, shards, tokencount, urlrules
from skein.llm.queries import QUERIES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "the cat sat on the mat and the dog ran after the red ball in the park all day", "en", "a"),
    (2, None, None, None), (3, "", "en", "a"), (4, "   \n\t ", "en", "b"), (None, "a null id has words too", "en", "b"),
    (5, "日本語 のテキスト", None, "c"), (6, "x", "en", "c"), (7, "!!! 123 $$$", "en", None), (8, "word " * 40_000, "en", "a"), (9, "y" * 200_000, "en", "b"),
    (1, "the cat sat on the mat and the dog ran after the red ball in the park all day", "en", "a"),
    (10, "▁mark and\x00zero <|endoftext|> end", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in ODD], f"{SCHEMA}, line_places int, n_words string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


# 1 ---------------------------------------------------------------------------
def base_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_quality_base_counts(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for d in documents:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_hand(d.text)
        assert not (r.base_failed and r.kept)


def probability_by_hand(model, text):
    """The calibrated score from the n-grams themselves, in plain Python."""
    words = [w.encode() for w in WORD.findall(text)]
    h = [int(x) for x in quality.word_hashes(words)]
    wide = (1 << 64) - 1

    def mixed(x):
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * mult & wide
        return x ^ (x >> 31)

    pairs = [mixed((a * int(common._PLACES[0]) + b * int(common._PLACES[1])) & wide) for a, b in zip(h, h[1:])]
    blocks = [[mixed(x) >> 49 for x in h], [x >> 49 for x in pairs]]
    for k in (3, 5):
        found = []
        for i in range(len(text) - k + 1):
            x = 0
            for c in text[i : i + k]:
                x = (x * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
            found.append((x * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
        blocks.append(found)
    z = model.bias + sum(sum(float(model.weights[k][i]) for i in b) / len(b) for k, b in enumerate(blocks) if b)
    return 1 / (1 + np.exp(-(model.slope * z + model.offset)))


def test_quality_verdicts(spark, sf_dir, documents):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect()}
    for d in sorted(documents, key=lambda d: len(d.text or ""))[-60:-20]:
        p = probability_by_hand(model, d.text)
        assert abs(got[d.doc_id].p_good - p) < 1e-6 and got[d.doc_id].kept == (not got[d.doc_id].base_failed and got[d.doc_id].p_good >= quality.KEEP_AT)


def test_quality_of_an_id_with_many_rows(spark):
    rows = [(7, f"text number {k} of the busy id") for k in range(500)] + [(k, "alone here") for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(7, 1), (7, 1), *((k, k % 2) for k in range(10, 30))], "doc_id long, quality int")
    models = [quality.fit_quality(d, labels) for d in (docs, docs.repartition(3))]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias


def test_quality_learns_on_other_rows(spark):
    rng = random.Random(1)
    good, bad = [f"w{k}en" for k in range(300)], [f"{k}%%%" for k in range(300)]
    rows = [(k, " ".join(rng.choices(good if k % 3 else bad, k=60)), int(k % 3 > 0)) for k in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(r[0], r[2]) for r in rows[:600]], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.quality(spark, docs, model).collect()}
    right = sum((got[k].p_good >= 0.5) == bool(q) for k, _, q in rows[600:])
    assert right >= 295


def test_quality_learns_from_whole_texts(spark):
    rng = random.Random(2)
    good, bad = [f"w{k}en" for k in range(300)], [f"{k}%%%" for k in range(300)]
    same = "all of them open with these words " * 200
    rows = [(k, same + " ".join(rng.choices(good if k % 2 else bad, k=600)), k % 2) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(r[0], r[2]) for r in rows[:150]], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.quality(spark, docs, model).collect()}
    assert all((got[k].p_good >= 0.5) == bool(q) for k, _, q in rows[150:])


def test_quality_odd_rows(spark, odd, empty):
    one_class = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = quality.fit_quality(odd, one_class)
    got = quality.quality(spark, odd, model).collect()
    assert len(got) == len(ODD) and all(r.base_failed for r in got if r.doc_id in (2, 3, 4, 6, 9)) and {r.n_words for r in got if r.doc_id == 2} == {0}
    assert sorted((r.n_words, r.n_repeat_words) for r in got)[-1] == (40_000, 40_000)
    assert quality.quality(spark, empty, quality.fit_quality(empty, one_class)).count() == 0


# 2 ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    return tokencount.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, sf_dir, documents, tokenizer):
    got = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    for d in documents:
        n = len(tokenizer.encode(d.text or "", add_special_tokens=False).ids)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 1024)


def test_token_counts_odd_rows(spark, odd, empty, tokenizer):
    got = tokencount.token_counts(odd, public_tokenizers.path("byte_bpe_50k.json"), chunk_chars=1000, overlap_chars=16).collect()
    want = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert tokencount.token_counts(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_resynchronisation_on_random_text(tokenizer):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "1", "23", "'s", "'", "<|endoftext|>", "<|endof", "日本", "\x1c", "\x85", ".", ",", "Hello", " World", "😀", "́",
             "\t", "\r\n", "。", "Привет", "\u3000", "、", "مرحبا", "؟"]
    counter = tokencount.PartCounter(public_tokenizers.path("byte_bpe_50k.json"), cache_parts=50)
    for _ in range(2500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert counter.count([text, "", text]) == [len(ids), 0, len(ids)]
        assert [t[0] for t in tokencount.encode_resync(tokenizer, text, rng.choice([6, 12, 20]), rng.choice([2, 4, 8]))] == ids


@pytest.mark.parametrize("words,between", [("привет мир как дела", " "), ("مرحبا العالم كيف", " "), ("日本語 漢字 中文 你好", ""), ("plain words here", "\n")])
def test_huge_texts_take_few_encodes(tokenizer, words, between):
    rng, chunk = random.Random(4), 8192
    text = between.join(rng.choice(words.split()) + ("。" if rng.random() < 0.05 else "") for _ in range(60_000))
    # One place without a blank or a mark for longer than a chunk: widened there, not after.
    text = text[:90_000] + "漢" * 20_000 + text[90_000:]
    calls = tokencount.Resync(tokenizer, text, chunk, 512)
    assert [t[0] for run in calls.runs() for t in run] == tokenizer.encode(text, add_special_tokens=False).ids
    assert calls.encodes <= -(-len(text) // (chunk - 512)) + 12


def test_parts_of_every_kind_of_white_space():
    store = parts.PartStore(lambda new: list(new), cache_parts=20)
    texts = ["", " ", "a b", " a", "a  b", "a\nb\n\nc", "a \n b", "\ta\tb", "x <y> z", "a\x1c b", "end ", "a b\n"] * 3
    for some in (texts, texts[::-1], []):
        got = store.of(some)
        at = [*got.begins.tolist(), len(got.index)]
        assert ["".join(got.values[k] for k in got.index[i:j].tolist()) for i, j in zip(at[:-1], at[1:])] == some
    long = "".join(random.Random(2).choices(["word", " ", "\n", "<x", "\t"], k=500))
    for size in (1, 7, 100):
        some = [x for x, _ in parts.slices(long, size)]
        assert "".join(some) == long and len(some) > 3 and [last for _, last in parts.slices(long, size)] == [False] * (len(some) - 1) + [True]
        cuts = set(accumulate(map(len, some[:-1])))
        assert cuts <= {m.start() for m in re.finditer(r"(?=[ \n\t][^\s<])", long)}
    assert ["".join(x) for _, x, _ in parts.groups(["ab " * 9, None, "", "c"], most=5)] == ["ab " * 9, "c"]


# 3 ---------------------------------------------------------------------------
def check_shards(got, n_shards, n):
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in range(n_shards))


def test_sharding(spark, sf_dir, documents):
    got = QUERIES["op3_sharding"](spark, sf_dir).collect()
    check_shards(got, 8, len(documents))
    texts = {d.doc_id: (d.text or "").encode() for d in documents}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in got)


def placed_by_hand(rows, n_shards):
    """Shards by walking the ring's cells, rows of a cell in their stated order."""
    cells = 1 << shards.LG_CELLS
    home = shards.owners(n_shards)
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    at, over = defaultdict(list), []
    for r in sorted(rows, key=lambda r: (r.cell, r.at, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32)):
        s = home[r.cell]
        if room[s]:
            room[s] -= 1
            at[r.cell, r.doc_id, r.size, r.text_crc32].append(s)
        else:
            over.append(r)
    for r in over:
        c = r.cell
        while not room[home[c]]:
            c = (c + 1) % cells
        room[home[c]] -= 1
        at[r.cell, r.doc_id, r.size, r.text_crc32].append(home[c])
    return Counter((k[1:], s) for k, v in at.items() for s in v)


def test_sharding_of_one_hot_id(spark, odd, empty):
    rows = [(7 if k % 2 else k, f"t{k % 50}", "x") for k in range(3000)] + [(8, "copy", "y")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string, cell string")
    got = shards.shard(df, 5).collect()
    check_shards(got, 5, 4500)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    other = shards.shard(df.repartition(7), 5, part_rows=3, copy_rows=100).collect()
    assert Counter(got) == Counter(other)
    keyed = df.selectExpr("doc_id", "cast(octet_length(text) + 1 as long) AS size", "crc32(cast(text as binary)) AS text_crc32").selectExpr(
        "*", f"cast(shiftrightunsigned(xxhash64(doc_id, 'ring'), {64 - shards.LG_CELLS}) as int) AS cell",
        f"shiftrightunsigned(xxhash64(doc_id, size, text_crc32, 'order'), {64 - shards.ORDER_BITS}) AS at")
    assert Counter(((r.doc_id, r.size, r.text_crc32), r.shard) for r in got) == placed_by_hand(keyed.collect(), 5)
    check_shards(shards.shard(odd, 4).collect(), 4, len(ODD))
    assert shards.shard(empty, 4).count() == 0


def test_a_new_shard_moves_little(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    old, new = ({r.doc_id: r.shard for r in shards.shard(docs, n).collect()} for n in (8, 9))
    moved = sum(old[k] != new[k] for k in old)
    assert moved <= 0.25 * len(old), moved


def test_bounded_loads_move_little():
    rng = np.random.default_rng(5)
    counts = rng.poisson(3, 1 << shards.LG_CELLS)
    home = shards.owners(8)
    runs = shards.place(counts, 8)
    assert sum(r.hi - r.lo for r in runs) == counts.sum()
    away = sum(r.hi - r.lo for r in runs if home[r.cell] != r.shard)
    load = np.bincount(home, counts, 8)
    assert away == np.maximum(load - [counts.sum() // 8 + (s < counts.sum() % 8) for s in range(8)], 0).sum()


# 4 ---------------------------------------------------------------------------
def components_by_hand(rows):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[root(i)])) for i in range(len(rows))}


def test_near_duplicates(spark, sf_dir, documents):
    want = components_by_hand([(d.doc_id, d.text) for d in documents])
    got = QUERIES["op4_near_duplicates"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(n_bases=6, copies=30, words=90, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for b in range(n_bases):
        base = rng.choices(vocabulary, k=words)
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("node,largest,group", [(64, 16_384, 3_000_000), (8, 32, 2_000), (2, 4, 600)])
def test_near_duplicates_of_edited_groups(spark, node, largest, group):
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, node=node, largest=largest, group_shingles=group).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_hand(rows)


def test_labels_by_postings():
    rows = edited(3, 25) + [(1000 + k, f"no link at all {k} to any other text here") for k in range(40)]
    sets = [neardup.shingle_set(t.encode()) for _, t in rows]
    want = components_by_hand(rows)
    label = neardup.label_linked(sets).tolist()
    assert len({*zip(label, (want[k][1] for k, _ in rows))}) == len({*label}) == len({c for _, c in want.values()})


def planted(n, band, rng):
    """Pairs of texts whose shingle sets have a similarity within the band."""
    while n:
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        other = list(words)
        for _ in range(rng.randint(1, max(2, len(words) // 30))):
            other[rng.randrange(len(words))] = f"u{rng.randrange(5000)}"
        a, b = (neardup.shingle_set(" ".join(x).encode()) for x in (words, other))
        both = np.intersect1d(a, b).size
        if band[0] <= both / (len(a) + len(b) - both) < band[1]:
            n -= 1
            yield " ".join(words), " ".join(other)


@pytest.mark.parametrize("band", [(0.75, 0.8), (0.8, 0.85), (0.85, 1.0)])
def test_recall_where_nodes_branch(spark, band, monkeypatch):
    # All nodes of two classes or more branch down to the last level, which
    # compares no more than two: what is left is what the paths find.
    rng = random.Random(6)
    pairs = list(planted(400, band, rng))
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    deep = []
    monkeypatch.setattr(neardup, "_children", lambda level, old=neardup._children: deep.append(level) or old(level))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), node=1).collect()}
    assert max(deep) == neardup.LEVELS - 1
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(len(pairs))) >= 0.99 * len(pairs)


def test_documents_branch(spark, monkeypatch):
    deep = []
    monkeypatch.setattr(neardup, "_children", lambda level, old=neardup._children: deep.append(level) or old(level))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = neardup.near_duplicates(docs)
    assert got.count() == docs.count() and max(deep) >= 1


def test_a_large_group_of_near_copies_is_confirmed_in_linear_size(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, f"x{k}", *(f"y{rng.randrange(9)}" for _ in range(3))])) for k in range(4000)]
    rows += [(5000 + k, " ".join([*base[:40], *(f"z{k}_{j}" for j in range(4))])) for k in range(10)]
    met = []
    old = neardup._by_group

    def count(df, fn, out):
        if fn is neardup.confirm:
            met.append(df.count())
        return old(df, fn, out)

    neardup._by_group = count
    try:
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), group_shingles=20_000).collect()}
    finally:
        neardup._by_group = old
    assert {got[k] for k in range(4000)} == {0} and sum(met) <= 3 * len(rows), met


def test_many_copies_of_one_row(spark):
    docs = spark.createDataFrame([(1, "the same text again and again")] * 3000 + [(2, "the same text again and again"), (3, "another one of the few")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == {(1, 1, True): 3000, (2, 1, False): 1, (3, 3, True): 1}


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert all(by[k].n_shingles == 0 and by[k].kept and by[k].component_id == k for k in (2, 3, 4))
    assert by[8].n_shingles == 1 and by[9].n_shingles == 1 and sum(r.component_id == 1 for r in got) == 2
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(empty).count() == 0


# 5 ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_lossless_and_reproducible(spark, sf_dir, documents, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in QUERIES["op5_piece_sampling"](spark, sf_dir).collect()}
    assert len(got) == len(documents) and all(r.lossless for r in got.values())
    one = spark.createDataFrame([(d.doc_id, d.text) for d in documents[:20]], "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.ids for r in pieces.encode(one, path).collect()} == {d.doc_id: got[d.doc_id].ids for d in documents[:20]}
    encoded = pieces.encode(odd, path)
    found = encoded.collect()
    assert all(r.lossless for r in found) and {r.ids is None for r in found if r.doc_id == 2} == {True} and {len(r.ids) for r in found if r.doc_id == 3} == {0}
    texts = Counter((r.doc_id, r.text) for r in pieces.decode(encoded, path).collect())
    assert texts == Counter((r[0], r[1]) for r in ODD)
    assert pieces.encode(empty, path).count() == 0


def test_pieces_are_drawn_by_weight(vocabulary):
    word, n = "thorre", 20_000
    inverse = {v: k for k, v in enumerate(vocabulary.table) if v and k > 258}

    def all_ways(b):
        return [[]] if not b else [[inverse[b[:k]], *x] for k in range(1, len(b) + 1) if b[:k] in inverse for x in all_ways(b[k:])]

    ways = all_ways(f" {word}".encode())
    p = np.exp([sum(vocabulary.weight[i] for i in w) for w in ways])
    flat, count = vocabulary.sample([word] * n, np.array([pieces.row_seed(k, 9) for k in range(n)], np.uint64))
    at = np.concatenate([[0], np.cumsum(count)])
    drawn = Counter(tuple(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
    assert set(drawn) <= {tuple(w) for w in ways}
    assert max(abs(drawn[tuple(w)] / n - x) for w, x in zip(ways, p / p.sum())) < 0.02


def test_few_and_many_chunks_are_drawn_alike(vocabulary, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["漢", "the", "ab", "привет", "qzx", "😀", "▁", "1", " "], k=rng.randint(0, 200))) for _ in range(100)] + ["y" * 3000, "ab" * 2000]
    seeds = np.array([pieces.row_seed(k, 0) for k in range(len(texts))], np.uint64)
    found = []
    for few, walks in ((48, 4), (1, 0), (10**9, 10**9)):
        monkeypatch.setattr(pieces, "FEW", few)
        monkeypatch.setattr(pieces, "FEW_WALKS", walks)
        found.append(vocabulary.sample(texts, seeds))
    assert all((f == found[0][0]).all() and (n == found[0][1]).all() for f, n in found)


def test_long_texts_are_cut_where_no_piece_spans(vocabulary, monkeypatch, spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["漢", "字", "the", "ab", "ы", "qzx", "😀", "▁", "1"]) for _ in range(9000))
    cuts = vocabulary.cut_nodes(text)
    assert len(cuts) >= len(text) // (2 * pieces.LONG_CHUNK)
    longest = max(len(p) for p in vocabulary.table) + 1
    known = {p for p in vocabulary.table if p}
    for c in cuts:
        spans = {text[a:b].encode() for a in range(max(0, c - longest), c) for b in range(c + 1, c + longest) if b <= len(text)}
        assert not spans & known
    rows = [(1, text), (2, "a " * 30_000), (3, " "), (4, ""), (5, None), (6, "one two  three"), (7, text + " b " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = {r.doc_id: r for r in pieces.encode(df, path).collect()}
    assert all(r.lossless for r in whole.values()) and whole[4].ids == [] and whole[5].ids is None
    # Stretches of any length give the same ids.
    batches = [(k, t) for k, t in rows]
    keys = {k: pieces.row_seed(k, 0) for k, _ in rows}
    monkeypatch.setattr(pieces, "BATCH_CHARS", 700)
    got = {k: [] for k, _ in rows}
    for numbers, some, places in pieces._stretches([t for _, t in batches]):
        flat, n = vocabulary.sample(some, np.array([keys[rows[k][0]] for k in numbers], np.uint64), np.array(places))
        at = np.concatenate([[0], np.cumsum(n)])
        for k, a, b in zip(numbers, at[:-1], at[1:]):
            got[rows[k][0]] += flat[a:b].tolist()
    assert all(got[k] == (whole[k].ids or []) for k in got)


# 6 ---------------------------------------------------------------------------
def test_language_id_on_held_out_rows(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, sf_dir).collect()}
    held = [d for d in documents if zlib.crc32(str(d.doc_id).encode()) % 5 == 0 and d.lang]
    assert {k for k, r in got.items() if r.held_out} == {d.doc_id for d in documents if zlib.crc32(str(d.doc_id).encode()) % 5 == 0}
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_by_hand(spark, sf_dir, documents):
    """Filters as sets of cells, look-ups one n-gram at a time."""
    def grams(text):
        b = b"  " + (text or "").encode().lower() + b"  "
        return [int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3)]

    def cells(g):
        out = []
        for k in range(langid.HASHES):
            h = g * langid._MULTIPLIERS[k] & 0xFFFFFFFF
            h = (h ^ h >> 15) * langid._MULTIPLIERS[k + 1] & 0xFFFFFFFF
            out.append(h >> 14)
        return out

    learnt = [d for d in documents if d.lang and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 5]
    total = Counter(d.lang for d in learnt)
    assert max(total.values()) <= langid.TEXTS_PER_LANG
    n = {x: Counter(g for d in learnt if d.lang == x for g in set(grams(d.text))) for x in total}
    full = {x: {c for g, k in n[x].items() if k >= max(2 if total[x] > 20 else 1, 0.01 * total[x]) for c in cells(g)} for x in total}
    false = {x: (len(c) / langid.CELLS) ** langid.HASHES for x, c in full.items()}
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, sf_dir).collect()}
    for d in documents:
        if not any(map(str.isalpha, d.text or "")):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0)
            continue
        g = [cells(x) for x in grams(d.text)]
        fair = {x: max(sum(all(c in full[x] for c in three) for three in g) - len(g) * false[x], 0) / (1 - false[x]) for x in total}
        best = max(fair, key=lambda x: (fair[x], total[x], x))
        assert got[d.doc_id].lang_pred == best and abs(got[d.doc_id].score - min(fair[best] / len(g), 1)) < 1e-9


def test_more_than_64_languages(spark, sf_dir):
    rng = random.Random(9)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)] for k in range(70)}
    rows = [(k, " ".join(rng.choices(words[x], k=60)), x) for k, x in enumerate([*words] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.langs) == 70 and model.cells.shape == (2, langid.CELLS)
    got = {r.doc_id: r for r in langid.identify(spark, docs, model).collect()}
    assert sum(got[k].lang_pred == x for k, _, x in rows if got[k].held_out) >= 0.99 * sum(r.held_out for r in got.values())


def test_language_id_learns_from_whole_texts(spark):
    # What tells the two apart comes after 50,000 characters that they share.
    same = "the very same opening words " * 1800
    tail = {"aa": "kuroi neko wa nemutte iru ", "bb": "gelbe hunde laufen durch wald "}
    rows = [(k, same + tail["ab"[k % 2] * 2] * 100, "ab"[k % 2] * 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark, docs.withColumn("text", F.substring("text", len(same) + 1, 1 << 20)), langid.learn(docs)).collect()}
    assert all(got[k] == x for k, _, x in rows)


def test_language_id_odd_rows(spark, odd, empty):
    model = langid.learn(odd)
    got = langid.identify(spark, odd, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and all(by[k].lang_pred == "und" and by[k].score == 0 for k in (2, 3, 4, 7)) and by[6].lang_pred == "en" and not by[None].held_out
    assert {r.lang_pred for r in langid.identify(spark, odd, langid.learn(empty)).collect()} == {"und"}
    assert langid.identify(spark, empty, model).count() == 0 and langid.keep_identified(spark, odd, model).columns == odd.columns


def test_filter_has_no_false_negatives():
    cells = np.zeros((1, langid.CELLS), np.uint8)
    g = np.arange(5000, dtype=np.uint32) * np.uint32(2654435761)
    for i in range(langid.HASHES):
        cells[0, langid.cells_of(g, i)] |= 1
    assert (langid.LanguageFilter(["x"], cells, np.zeros(1)).holders(g) == 1).all()


# 7 ---------------------------------------------------------------------------
def rule_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_url_filters(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op7_url_filters"](spark, sf_dir).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        host, path, rule = rule_by_hand(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == rule.verdict


def test_url_odd_rows_and_mined_rules(spark):
    urls = [None, "", "no scheme", "http://", "x://A.COM", "http://b.com?u=/en/", "http://EXAMPLE.com/en/1#f", "a://b://c.net/es/", "http://example.com/en", "http://www.example.com/en/x\ny"]
    urls += [f"http://spam{k}.org/buy/now" for k in range(40)] + [f"http://site{k}.org/read/{k}" for k in range(40)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    for c in ("host", "path", "rule", "given", "verdict", "tokens", "label"):
        df = df.withColumn(c, F.lit("of the page"))
    mined = [urlrules.MinedRule((("path:buy",), ("path:now",)), "block", 1.0, 0.5)]
    got = {r.page_id: r for r in urlrules.judge(spark, df, URL_RULES, mined).collect()}
    for k, u in enumerate(urls):
        host, path, rule = rule_by_hand(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.name)
        assert got[k].verdict == (rule.verdict if rule else "block" if u and "/buy/now" in u else "allow")
    labelled = spark.createDataFrame([(["path:buy", "path:now", f"host:{k % 7}"], "block") for k in range(50)] + [(["path:read", "path:now"], "allow") for _ in range(50)], "tokens array<string>, label string")
    rules = urlrules.mine(labelled, 0.05, 0.9)
    assert {(r.items, r.label) for r in rules} >= {((("path:buy",),), "block"), ((("path:read",),), "allow")} and all(r.confidence >= 0.9 for r in rules)
    assert not any(len(r.items) > 1 and ("path:buy",) in r.items for r in rules)
    assert urlrules.mine(labelled.limit(0)) == [] and urlrules.judge(spark, df.limit(0), URL_RULES).count() == 0


def test_rules_of_many_equal_token_sets(spark):
    rows = spark.range(260_000).selectExpr("array(concat('path:s', id % 20)) AS tokens", "if(id % 2 = 0, 'allow', 'block') AS label")
    got = {r.items: (r.label, r.confidence, round(r.support, 6)) for r in urlrules.mine(rows)}
    assert got == {((f"path:s{k}",),): ("block" if k % 2 else "allow", 1.0, 0.05) for k in range(20)}


def test_tokens_that_go_together_are_one_item(spark):
    # 30 tokens of one path: as single items they have 2 ** 30 frequent sets.
    long = [f"path:p{k}" for k in range(30)]
    rows = [(long, "block")] * 60 + [(["path:a", f"path:n{k}"], "allow") for k in range(60)] + [(None, "allow"), (["path:a"], None)]
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05)
    assert {(r.items, r.label) for r in got} == {((tuple(sorted(long)),), "block"), ((("path:a",),), "allow")}
    index = urlrules.RuleIndex(got)
    assert index.first(["path:p3"]).label == "block" and index.first(["path:a", "path:zz"]).label == "allow" and index.first(["path:zz"]) is None


def tokens_by_hand(url, host, path):
    if not host:
        return set()
    query = re.search(r"\?([^#]*)", url)
    parts = [("host:", host.split(".")), ("path:", re.split("[/._-]", path)), ("key:", [x.split("=")[0] for x in (query[1] if query else "").split("&")])]
    return {kind + re.sub("[0-9]+", "0", x) for kind, some in parts for x in some if x}


def rules_by_hand(rows, least, sure):
    """All token sets of the labelled rows, counted one by one."""
    n, of, both = len(rows), Counter(), Counter()
    one = Counter(t for tokens, _ in rows for t in tokens)
    for tokens, label in rows:
        known = sorted(t for t in tokens if one[t] >= least * n)
        for k in range(1, len(known) + 1):
            for x in combinations(known, k):
                of[x] += 1
                both[x, label] += 1
    share = Counter(label for _, label in rows)
    kept = []
    for (x, label), m in sorted(both.items(), key=lambda r: (len(r[0][0]), r[0])):
        c = m / of[x]
        if m >= least * n and c >= sure and c > share[label] / n and not any(y[1] == label and y[2] >= c and set(y[0]) < set(x) for y in kept):
            kept.append((x, label, c, m / n))
    return kept


def test_mined_verdicts(spark, sf_dir):
    """Verdicts of pages that no given rule decides, and of held-out ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: (r.url, *rule_by_hand(r.url)) for r in pages.collect()}
    tokens = {k: tokens_by_hand(url, host, path) for k, (url, host, path, _) in rows.items()}
    rules = rules_by_hand([(tokens[k], r[3].verdict) for k, r in rows.items() if r[3]], urlrules.MIN_SUPPORT, urlrules.MIN_CONFIDENCE)
    for r in QUERIES["op7_url_filters"](spark, sf_dir).collect():
        if not rows[r.page_id][3]:
            fired = [x for x in rules if set(x[0]) <= tokens[r.page_id]]
            best = max((x[2] for x in fired), default=None)
            assert r.confidence == best
            assert r.verdict in ({x[1] for x in fired if x[2] == best} if fired else {"allow"})


def test_mined_rules_on_held_out_pages(spark):
    """Accuracy of the mined rules where the given ones are left out of judging."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = urlrules.host_and_path(F.col("url"))
    h, p = F.col("host"), F.col("path")
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select(
        "page_id", "url", urlrules.best_rule(URL_RULES, h, p, "verdict").alias("label"), urlrules.tokens(F.col("url"), h, p).alias("tokens")).where("label is not null")
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    mined = urlrules.mine(rows.where(~held).select("tokens", "label"))
    want = {r.page_id: r.label for r in rows.where(held).collect()}
    got = {r.page_id: r.verdict for r in urlrules.judge(spark, rows.where(held), [], mined).collect()}
    right = sum(got[k] == x for k, x in want.items()) / len(want)
    print("held-out pages", len(want), "right", right)
    assert right >= 0.95


# 8 ---------------------------------------------------------------------------
def packed_by_hand(texts, end, seq_tokens):
    """The token stream of the texts, in sequences."""
    encoding = order.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    stream = [t for text in texts if text is not None for t in (*encoding.encode_ordinary(text), end)]
    stream += [end] * (-len(stream) % seq_tokens)
    return [stream[k : k + seq_tokens] for k in range(0, len(stream), seq_tokens)]


def check_order(got, out, want, key, seq_tokens, shard_seqs):
    """The manifest and the shards' bytes against the sequences wanted."""
    got = sorted(got)
    n, place = len(want), order.Feistel(len(want), key)
    slot = place.slot(np.arange(n))
    assert [r.slot for r in got] == list(range(n)) and [r.seq for r in got] == place.index(np.arange(n)).tolist()
    records = [ids for _, ids in order.ShardReader(out, n, seq_tokens, shard_seqs).read()]
    assert all(records[s].tolist() == w for s, w in zip(slot.tolist(), want))
    assert all(zlib.crc32(records[r.slot].tobytes()) == r.crc32 and r.offset == r.slot % shard_seqs * 2 * seq_tokens for r in got)


def test_training_order_does_not_depend_on_splits(spark, documents, tmp_path):
    path, table = public_tokenizers.path("byte_bpe_50k.tiktoken"), str(tmp_path / "table")
    df = spark.createDataFrame([(d.doc_id, d.text) for d in documents], "doc_id long, text string").repartition(3)
    df.write.option("parquet.block.size", 1 << 16).option("parquet.page.row.count.limit", 100).parquet(table)
    stored = [r.text for f in sorted(Path(table).glob("*.parquet")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    want, parts = packed_by_hand(stored, 50256, 64), set()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k, size in enumerate(("128m", "40k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        docs, out = spark.read.parquet(table), str(tmp_path / f"shards{k}")
        parts.add(docs.rdd.getNumPartitions())
        check_order(order.materialise(docs, out, path, public_tokenizers.PATTERN, 50256, key=3, seq_tokens=64, shard_seqs=500).collect(), out, want, 3, 64, 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(parts) == 2
    reader = order.ShardReader(out, len(want), 64, 500)
    assert [s for s, _ in reader.read(len(want) - 7)] == list(range(len(want) - 7, len(want)))
    assert not list(Path(out).glob(".shard*")) and len(list(Path(out).glob("shard*"))) == -(-len(want) // 500)
    (Path(out) / "shard-000000.bin").write_bytes(b"short")
    with pytest.raises(EOFError):
        list(reader.read())


def test_training_order_of_the_registered_query(spark, sf_dir, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "shared_path", lambda spark, name: str(tmp_path / name))
    got = QUERIES["op8_training_order"](spark, sf_dir).collect()
    check_order(got, str(tmp_path / "ordered"), packed_by_hand([d.text for d in documents], 50256, order.SEQ_TOKENS), 0, order.SEQ_TOKENS, order.SHARD_SEQS)


def test_training_order_of_computed_rows(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id, repeat(' word', id % 7)) AS text").repartition(4)
    for _ in range(2):  # the second run writes over the first one
        got = order.materialise(docs, str(tmp_path), path, public_tokenizers.PATTERN, 50256, seq_tokens=16, shard_seqs=32).collect()
    encoding = order.load_encoding(path, public_tokenizers.PATTERN)
    records = [ids.tolist() for _, ids in order.ShardReader(str(tmp_path), len(got), 16, 32).read()]
    stream = [t for r in sorted(got, key=lambda r: r.seq) for t in records[r.slot][: r.n_tokens]]
    texts, at = Counter(), 0
    for k, t in enumerate(stream):
        if t == 50256:
            texts[encoding.decode(stream[at:k])] += 1
            at = k + 1
    assert texts == Counter(r.text for r in docs.collect())


def test_permutation():
    for n in (1, 2, 3, 100, 4097):
        f = order.Feistel(n, 11)
        s = f.slot(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and (f.index(s) == np.arange(n)).all()


def test_training_order_odd_rows(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = order.materialise(odd, str(tmp_path / "a"), path, public_tokenizers.PATTERN, 50256).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert order.materialise(empty, str(tmp_path / "b"), path, public_tokenizers.PATTERN, 50256).count() == 0


# 9 ---------------------------------------------------------------------------
def test_line_dedup_odd_rows(spark, odd, empty):
    got = linespread.remove_boilerplate(odd)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in ODD)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and linespread.remove_boilerplate(empty).count() == 0


def test_line_dedup_with_clashing_names(spark):
    line = "accept all of our cookies"
    rows = [(k, f"own {k}\n{line}", f"s{k % 4}", k, "a", "b", 5, None) for k in range(12)]
    names = ["n_lines", "n_removed", "line_text_hash", "line_places", "h1"]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{x} {t}' for x, t in zip(names, ('long', 'string', 'string', 'int', 'string')))}")
    got = linespread.remove_boilerplate(df)
    assert got.columns == [*df.columns, "n_lines_", "n_removed_"]
    assert {(r.doc_id, r.text, *(r[x] for x in names)) for r in got.collect()} == {(k, f"own {k}" if k else f"own 0\n{line}", k, "a", "b", 5, None) for k in range(12)}


def test_line_dedup_keeps_the_first(spark):
    line = "accept all of our cookies"
    rows = [(k, f"own line number {k}\n{line}\nshort", "en", f"s{k % 4}") for k in range(40)] + [(99, f"{line}", "en", "s0")]
    few = "seen on two sites only"
    rows += [(100 + k, f"{few}\nbody text of {k}", "en", f"s{k % 2}") for k in range(20)]
    got = {r.doc_id: r for r in linespread.remove_boilerplate(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert line in got[0].text and all(line not in got[k].text for k in [*range(1, 40), 99])
    assert got[99].text == "" and got[5].text == "own line number 5\nshort" and got[5].n_removed == 1 and all(few in got[100 + k].text for k in range(20))


# 10 --------------------------------------------------------------------------
CLEAN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_by_hand(text, items):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words, hit, names = CLEAN.findall(lower(text)), set(), set()
    for name, t in items:
        w = CLEAN.findall(lower(t))
        k = min(13, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                names.add(name)
    listed = ",".join(sorted(str(x) for x in names if x is not None))
    return len(words), len(hit), len([x for x in names if x is not None]), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontamination(spark, block):
    rng = random.Random(4)
    v = [f"v{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(v, k=rng.choice([2, 5, 13, 20])))) for k in range(8)] + [(8, None), (9, "?!"), (None, "alone here"), (3, "Again THREE")]
    docs = []
    for k in range(60):
        words = rng.choices(v, k=rng.randint(0, 60))
        if k % 3 == 0:
            t = (items[rng.randrange(8)][1] or "").upper().split()
            words[5:5] = t
        docs.append((k, ", ".join(words)))
    docs += [(60, None), (61, "alone... here"), (None, items[0][1]), (5, "again three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench, block_bytes=block).collect()
    want = Counter((d, *contamination_by_hand(t, items)) for d, t in docs)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_proximity(spark):
    phrase = [f"p{k}" for k in range(13)]
    moved = phrase[:6] + ["x", "y"] + phrase[6:]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(phrase)), (3, " ".join(phrase[:5]))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(spark, docs, spark.createDataFrame([(7, " ".join(phrase))], "item_id long, text string")).collect()}
    assert (got[1].item_ids, got[1].near_item_ids) == ([], ["7"]) and (got[2].item_ids, got[2].near_item_ids) == (["7"], ["7"]) and got[3].near_item_ids == []


def test_proximity_without_the_rarest_words(spark):
    phrase = [f"p{k}" for k in range(13)]
    change = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(phrase))
    often = " ".join(phrase[:4] + phrase[5:])
    texts = [change(4), change(4, 5), change(4, 5, 6), change(0, 12), often, " ".join(phrase[:5])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for items in ([(7, " ".join(phrase))], [(7, change(4).replace("x", "nowhere"))]):
        found = decontam.decontaminate(spark, docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        got = {r.doc_id: r.near_item_ids for r in found}
        assert [got[k] for k in (0, 1, 2, 5)] == [["7"], ["7"], [], []]
        assert got[4] == ["7"]


def test_decontamination_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.decontaminate(spark, odd, none).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)
    assert decontam.decontaminate(spark, empty, none).count() == 0


def resident():
    """MB of this process that are no file's."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_a_worker_keeps_no_free_memory():
    """What a task freed is not held against the next one by a block above it."""
    before, held = resident(), []
    for got in common.freed(iter(["batch"])):
        blocks = [bytes(60_000) for _ in range(4_000)]
        held.append(bytes(60_000))
        del blocks
        during = resident()
    assert got == "batch" and during > before + 150
    assert resident() < before + 60


def test_segmenting_a_batch_takes_little_memory():
    """Two million characters in one batch: the lattice of a stretch, the ids
    of some of its rows, no more."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 12))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(vocabulary, k=70)) for _ in range(3_500)]
    model = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    n = 0
    tracemalloc.start()
    try:
        for out in pieces.encoded_batches(model, iter([batch]), 0):
            assert all(out.column(3).to_pylist())
            n += out.num_rows
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert n == len(texts)
    assert peak < 60

"""URL filters: given rules first, then mined association rules.

Spark's FP-growth mines combinations of URL tokens that go with a label.  Tokens
that stand in the same urls are one item, so that they don't multiply itemsets.
Rules pruned by support and confidence, and by whether a shorter one says as
much, are matched by an inverted index from token to rules.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import arrow_map, stage_table, unstage

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
#: Begins the item that stands for a label; no token holds its first character.
_MARK = "\x1flabel="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(rules: list[UrlRule], host: Column, path: Column, what: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path segments, query keys, fragment.

    Digits in a segment become one mark, so that numbers don't stay apart.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.concat(
        mark("host:", F.split(host, r"\.")), mark("path:", F.split(path, "[/._-]")),
        mark("key:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))))


@dataclass(frozen=True)
class MinedRule:
    """Fires where every item has a token; an item is a set of tokens that
    stood in the same labelled urls."""

    items: tuple[tuple[str, ...], ...]
    label: str
    confidence: float
    support: float

    @property
    def name(self) -> str:
        return " ".join("|".join(x) for x in self.items)


def _items(baskets: DataFrame, least: float) -> dict[str, list[str]]:
    """Tokens of at least ``least`` baskets, by the smallest token that stands
    in the same ones.

    A set of baskets is known by its size and the exclusive or of 128 bits of
    hash of each.  At most (tokens of a basket on average) / support tokens are
    frequent, whatever the number of baskets.
    """
    each = baskets.select(F.explode("tokens").alias("token"), F.xxhash64("row").alias("a"), F.xxhash64("row", F.lit("b")).alias("b"))
    sets = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= least)
    same = sets.groupBy("n", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("tokens")).collect()
    return {r["tokens"][0]: r["tokens"] for r in same}


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[MinedRule]:
    """Rules ``tokens -> label`` from all rows ``(tokens, label)``.

    A rule stays if it is more confident than the label's share, and than
    every stayed rule of fewer of its items.  What one item fewer says as well
    is pruned in Spark, before rules reach the driver; how many stay depends on
    the support, not on the number of rows.  Null tokens or labels are left
    out.  No rows give no rules.
    """
    baskets = stage_table(labelled.where("tokens is not null and label is not null").select(
        F.array_distinct("tokens").alias("tokens"), "label", F.monotonically_increasing_id().alias("row")), "baskets")
    shares = {r["label"]: r["count"] for r in baskets.groupBy("label").count().collect()}
    n = sum(shares.values())
    items = _items(baskets, min_support * n) if n else {}
    if not items:
        return []
    known = F.array(*[F.lit(x) for x in items])
    mark = F.concat(F.lit(_MARK), F.col("label"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        baskets.select(F.array_append(F.array_intersect("tokens", known), mark).alias("items")))
    sets = model.freqItemsets.select(F.sort_array(F.filter("items", lambda x: ~x.startswith(_MARK))).alias("items"),
                                     F.filter("items", lambda x: x.startswith(_MARK)).alias("label"), "freq")
    whole = sets.where((F.size("label") == 0) & (F.size("items") > 0)).select("items", F.col("freq").alias("of"))
    rules = stage_table(sets.where((F.size("label") == 1) & (F.size("items") > 0)).join(whole, "items").select(
        "items", F.substring(F.col("label")[0], len(_MARK) + 1, 1 << 30).alias("label"), (F.col("freq") / F.col("of")).alias("confidence"), (F.col("freq") / n).alias("support")), "rules")
    strong = rules.where(F.col("confidence") >= min_confidence)
    shorter = rules.select(F.col("items").alias("fewer"), "label", F.col("confidence").alias("as_good"))
    less = strong.where(F.size("items") > 1).select("items", "label", "confidence", F.explode("items").alias("x"))
    said = less.select("items", "label", "confidence", F.array_remove("items", F.col("x")).alias("fewer")).join(shorter, ["fewer", "label"]).where("as_good >= confidence")
    left = strong.join(said.select("items", "label").distinct(), ["items", "label"], "left_anti").collect()
    kept: list[MinedRule] = []
    index: dict[tuple, list[int]] = {}
    for r in sorted(left, key=lambda r: (len(r["items"]), r["items"])):
        hits = Counter(k for t in r["items"] for k in index.get((r["label"], t), ()))
        fewer = [kept[k] for k, m in hits.items() if m == len(kept[k].items)]
        if r["confidence"] > shares[r["label"]] / n and not any(k.confidence >= r["confidence"] for k in fewer):
            for t in r["items"]:
                index.setdefault((r["label"], t), []).append(len(kept))
            kept.append(MinedRule(tuple(tuple(items[t]) for t in r["items"]), r["label"], r["confidence"], r["support"]))
    unstage(baskets, rules)
    return sorted(kept, key=lambda k: (-k.confidence, -len(k.items), -k.support, k.items))


class RuleIndex:
    """Inverted index from token to rules; a rule fires when all its items hit."""

    def __init__(self, rules: list[MinedRule]):
        self.rules = rules
        self.of: dict[str, list[tuple[int, int]]] = {}
        for k, r in enumerate(rules):
            for i, item in enumerate(r.items):
                for t in item:
                    self.of.setdefault(t, []).append((k, i))

    def first(self, found: list[str]) -> MinedRule | None:
        hits = Counter(k for k, _ in {x for t in found for x in self.of.get(t, ())})
        fired = [k for k, n in hits.items() if n == len(self.rules[k].items)]
        return self.rules[min(fired)] if fired else None


def judge(spark: SparkSession, pages: DataFrame, rules: list[UrlRule], mined: list[MinedRule] | None = None, id_col: str = "page_id",
          url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined_rule, confidence)`` per row.

    Where a given rule fits, the longest decides.  Else the strongest mined
    rule does (confidence, then more items, then support), and without one
    ``default``.  ``mined`` may be given; otherwise the rows that given rules
    decide are the labels it is mined from.  Null urls and urls without
    ``://`` have empty host and path and no tokens, so the default holds.
    Repeated rows give a row each; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    rows = rows.select(
        "page_id", "host", "path", best_rule(rules, h, p, "name").alias("rule"), best_rule(rules, h, p, "verdict").alias("given"),
        F.when(h == "", F.array().cast("array<string>")).otherwise(tokens(F.col("url"), h, p)).alias("tokens"))
    if mined is None:
        mined = mine(rows.where("given is not null").select("tokens", F.col("given").alias("label")))
    sent = spark.sparkContext.broadcast(mined)
    index: list[RuleIndex] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not index:
            index.append(RuleIndex(sent.value))
        given, found = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        fired = [None if g is not None else index[0].first(t or []) for g, t in zip(given, found)]
        return pa.RecordBatch.from_arrays([
            *[batch.column(k) for k in range(4)],
            pa.array([g if g is not None else f.label if f else default for g, f in zip(given, fired)], pa.string()),
            pa.array([f.name if f else None for f in fired], pa.string()),
            pa.array([f.confidence if f else None for f in fired], pa.float64()),
        ], names=["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"])

    return arrow_map(rows, run, "page_id long, host string, path string, rule string, verdict string, mined_rule string, confidence double")

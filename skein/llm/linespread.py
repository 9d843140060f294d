"""Cross-site boilerplate lines, by the number of distinct sites of each line.

DataFrame functions only.  Lines are known by two hashes.  A plain aggregation
drops the lines that are too rare to matter; HyperLogLog sketches of the sites
of the rest are built piecewise and merged by aggregation; lines whose estimate
is near the threshold get exact distinct counts.  Of a boilerplate line the
first occurrence stays, the others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stage_table, unstage

#: A line on at least this many distinct sites is boilerplate.
MIN_SITES = 3
#: Lines of fewer words are never boilerplate.
MIN_WORDS = 3
#: 2 ** LG_K registers; the relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within so many standard errors, but one at least, are counted.
BAND = 5
#: Pieces into which a line's occurrences fall before their sketches merge.
PIECES = 16

# Anchored and possessive: linear in the line, also where it has no blank.
_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]++"


def boilerplate_lines(occurrences: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Staged keys ``(h1, h2)`` of lines on ``min_sites`` distinct sites or more.

    ``occurrences``: a staged table with h1, h2, site and piece.  A null site
    counts as no site.
    """
    # Hashes of sites, as their minima need no sort.  Staged, so that the join's
    # sides are plain exchanges, which can be split, or one is small enough.
    of_site = F.when(F.col("site").isNotNull(), F.xxhash64("site"))
    frequent = occurrences.groupBy("h1", "h2").agg(F.count("site").alias("n"), F.min(of_site).alias("lo"), F.max(of_site).alias("hi"))
    frequent = stage_table(frequent.where((F.col("n") >= min_sites) & ((F.lit(min_sites) < 2) | (F.col("lo") != F.col("hi")))).select("h1", "h2"), "frequent-lines")
    some = stage_table(occurrences.where("site is not null").join(frequent, ["h1", "h2"], "left_semi").select("h1", "h2", "site", "piece"), "line-sites")
    pieces = some.groupBy("h1", "h2", "piece").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    estimate = pieces.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites"))
    band = max(1.0, BAND * 1.04 / 2 ** (LG_K / 2) * min_sites)
    estimate = stage_table(estimate.where(F.col("sites") >= min_sites - band), "line-estimates")
    sure = estimate.where(F.col("sites") > min_sites + band).select("h1", "h2")
    near = estimate.where(F.col("sites") <= min_sites + band).select("h1", "h2")
    # A line's occurrences become its sites, map-side first, before any line
    # meets in one task.  An inner join, as a semi-join would be moved below.
    exact = (
        some.select("h1", "h2", "site").distinct().join(near, ["h1", "h2"])
        .groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    )
    bad = stage_table(sure.unionByName(exact), "boilerplate")
    unstage(frequent, some, estimate)
    return bad


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs``, the text without boilerplate, and two counts.

    The first of ``counts`` names the number of lines before, the second of
    those removed; a name that ``docs`` has gets underscores behind it.
    The occurrence with the smallest id (null ids last), then text hash, then
    place stays, so no passage leaves the corpus.  Null texts stay null with 0
    lines; an empty text has one empty line; null sites count for none.
    Repeated rows are alike: what stays in one stays in all.  Texts without a
    removed line are returned byte for byte.
    """
    key = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.col(site_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    lines = key.select("doc", "text_hash", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.where(F.col("line").rlike(rf"\A{_GAP}*+{_WORD}(?:{_GAP}++{_WORD}){{{min_words - 1}}}") if min_words > 0 else F.lit(True))
    occurrences = stage_table(
        lines.select("doc", "text_hash", "site", "place", F.xxhash64("line").alias("h1"), F.hash("line", F.length("line")).alias("h2"),
                     F.pmod(F.xxhash64("text_hash", "place"), F.lit(PIECES)).cast("int").alias("piece")), "lines")
    bad = boilerplate_lines(occurrences, min_sites)
    found = stage_table(occurrences.join(bad, ["h1", "h2"], "left_semi").select("h1", "h2", "doc", "text_hash", "place"), "boilerplate-places")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc").isNull().alias("z"), "doc", "text_hash", "place")).alias("first"))
    # Staged, so that the join's sides are plain exchanges, which can be split.
    first = stage_table(first, "first-places")
    goes = found.join(first, ["h1", "h2"]).where(
        ~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("place") == F.col("first.place"))))
    by_doc = stage_table(goes.groupBy("doc", "text_hash").agg(F.collect_set("place").alias("places")), "removals")
    unstage(occurrences, bad, found, first)

    taken = {c.lower() for c in docs.columns}
    name = lambda x: x if x not in taken else name(f"{x}_")
    h, d, g, p = name("line_text_hash"), name("line_doc"), name("line_goes_hash"), name("line_places")
    joined = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string"))).join(
        by_doc.select(F.col("doc").alias(d), F.col("text_hash").alias(g), F.col("places").alias(p)),
        (F.col(h) == F.col(g)) & F.col(id_col).cast("long").eqNullSafe(F.col(d)), "left")
    parts = F.split(F.col(text_col), "\n")
    cleaned = F.when(F.col(p).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(p), i)), "\n"))
    numbers = [F.when(F.col(x).isNull(), 0).otherwise(F.coalesce(F.size(y), F.lit(0))).cast("long") for x, y in ((text_col, parts), (p, F.col(p)))]
    return joined.select(
        *[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        *[n.alias(name(c)) for n, c in zip(numbers, counts)])

"""Benchmark decontamination by spaced seeds, in built-in SQL functions only.

A mask such as ``11101011`` keeps some word positions of a window and
ignores the others, so a window with substituted words at ignored places
still hashes alike. Seeds of the test items are joined with the seeds of
all training windows; each hit fixes an alignment, along which the overlap
is scored with +1 a matching and -1 a differing word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters at which texts are split into words.
_BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Seeds:
    """Masks, the score from which an overlap counts, and the size up to which seeds are broadcast.

    An item is looked for by every mask that fits in it. One of fewer words
    than the longest mask is looked for besides by a mask of all its words
    and, from five words on, by masks that ignore one of them.
    ``min_score`` is lowered to 0.6 of the item's words where that is less.
    """

    masks: tuple[str, ...] = ("11101011", "110100111")
    min_score: int = 8
    broadcast_bytes: int = 32 << 20


def words_of(text: Column) -> Column:
    """Lower-cased words; a null or blank text has none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _keys(words: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """Array of the seed hashes of the windows that begin at ``at``, null where a window would pass the end."""
    out = []
    for k, mask in enumerate(masks):
        kept = [F.get(words, at + p) for p, c in enumerate(mask) if c == "1"]
        out.append(F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(k), *kept)))
    return F.array(*out)


def overlaps(docs: DataFrame, items: DataFrame, seeds: Seeds = Seeds(), doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, score, start, matches``: the best verified overlap of each document and item.

    ``score`` is the best sum of +1 and -1 over a stretch of an alignment,
    ``matches`` the equal words of that alignment, ``start`` the word of the
    document where the item begins in it (negative: before the document).
    Ties go to the most matches, then the first start. Null and blank texts
    overlap nothing; repeated items and repeated documents count once;
    ``text_hash`` tells documents of one id (or none) apart. An empty table
    of either kind gives no rows; other columns are ignored.
    """
    own = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("item"))
    longest = max(map(len, seeds.masks))
    short = sorted(r[0] for r in own.select(F.size("item").alias("n")).where((F.col("n") > 0) & (F.col("n") < longest)).distinct().collect())
    masks, fits = list(seeds.masks), [F.size("item") >= len(m) for m in seeds.masks]
    for n in short:
        for ignored in (None, *(range(n) if n >= 5 else ())):
            masks.append("".join("0" if p == ignored else "1" for p in range(n)))
            fits.append(F.size("item") == n)
    at = own.select("*", F.explode(F.sequence(F.lit(0), F.size("item"))).alias("j"))
    keyed = at.select("item_id", "item", "j", F.posexplode(_keys(F.col("item"), F.col("j"), tuple(masks))).alias("mask", "key"))
    wanted = F.lit(False)
    for k, fit in enumerate(fits):
        wanted = wanted | ((F.col("mask") == k) & fit)
    lookup = keyed.where(wanted & F.col("key").isNotNull()).select("key", "item_id", "item", "j").distinct()
    size = lookup.agg(F.sum(F.lit(40) + F.aggregate("item", F.lit(0), lambda n, w: n + F.octet_length(w) + 16))).first()[0] or 0
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("words"))
    # Until the join all is one generated stage, in which the words of a text are passed on, not copied to each window;
    # a filter on the words here would split the text twice, and one on the score would end the generated stage early.
    spots = texts.select("*", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("i"))
    windows = spots.select("doc_id", "text_hash", "words", "i", F.explode(_keys(F.col("words"), F.col("i"), tuple(masks))).alias("key"))
    if size <= seeds.broadcast_bytes:
        hits = windows.join(F.broadcast(lookup), "key").withColumn("start", F.col("i") - F.col("j"))
    else:
        hits = _aligned(texts, own, windows, lookup)
    lead = F.greatest(-F.col("start"), F.lit(0))  # words of the item before the document begins
    n = F.least(F.size("item") - lead, F.size("words") - F.greatest("start", F.lit(0)))
    same = F.zip_with(
        F.slice("item", lead + 1, n), F.slice("words", F.greatest("start", F.lit(0)) + 1, n), lambda a, b: F.when(a == b, 1).otherwise(-1)
    )
    run = F.aggregate(
        "same",
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("equal")),
        lambda s, x: F.struct(
            F.greatest(s["now"] + x, F.lit(0)).alias("now"),
            F.greatest(s["best"], s["now"] + x).alias("best"),
            (s["equal"] + F.greatest(x, F.lit(0))).alias("equal"),
        ),
    )
    scored = hits.select("doc_id", "text_hash", "item_id", "start", F.size("item").alias("n"), same.alias("same")).select(
        "doc_id", "text_hash", "item_id", "start", "n", run.alias("run")
    )
    best = F.max(F.struct(F.col("run.best").alias("score"), F.col("run.equal").alias("matches"), (-F.col("start")).alias("back")))
    found = scored.groupBy("doc_id", "text_hash", "item_id", "n").agg(best.alias("best"))
    return found.where(F.col("best.score") >= F.least(F.lit(seeds.min_score), F.ceil(F.col("n") * 0.6))).select(
        "doc_id", "text_hash", "item_id", "best.score", (-F.col("best.back")).alias("start"), "best.matches"
    )


def _aligned(texts: DataFrame, items: DataFrame, windows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Hits of a table of seeds that is too large to be broadcast.

    Only keys and places are shuffled for the seeds; the words of texts and
    items join the alignments that are left, each once.
    """
    name = F.xxhash64("item_id", "item")
    seeds = lookup.select("key", name.alias("item_key"), "j").distinct()
    found = windows.select(F.xxhash64("doc_id", "text_hash").alias("doc_key"), "i", "key").join(seeds, "key")
    places = found.select("doc_key", "item_key", (F.col("i") - F.col("j")).alias("start")).distinct()
    each = texts.withColumn("doc_key", F.xxhash64("doc_id", "text_hash")).dropDuplicates(["doc_key"])
    return places.join(each, "doc_key").join(items.withColumn("item_key", name).dropDuplicates(["item_key"]), "item_key")


def decontaminated(docs: DataFrame, items: DataFrame, seeds: Seeds = Seeds(), doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that overlap no item, with all their columns; null and blank texts stay."""
    bad = overlaps(docs, items, seeds, doc_id, item_id, text).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t-\r]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t-\r]+') AS w FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE w <> ['']),
bp AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b WHERE w <> ['']),
masks AS (SELECT n, unnest(CASE WHEN n >= 5 THEN range(-1, n) ELSE [-1] END) AS z FROM (SELECT DISTINCT len(w) AS n FROM b WHERE w <> [''] AND len(w) < 9)),
dk AS (
  SELECT doc_id, i, concat_ws(' ', 'x', w[i], w[i+1], w[i+2], w[i+4], w[i+6], w[i+7]) AS k FROM dp WHERE i + 7 <= len(w)
  UNION ALL SELECT doc_id, i, concat_ws(' ', 'y', w[i], w[i+1], w[i+3], w[i+6], w[i+7], w[i+8]) FROM dp WHERE i + 8 <= len(w)
  UNION ALL SELECT doc_id, i, concat_ws(' ', n, z, array_to_string([CASE WHEN x = z THEN '' ELSE w[i + x] END FOR x IN range(n)], ' ')) FROM dp, masks WHERE i + n - 1 <= len(w)),
bk AS (
  SELECT item_id, i, concat_ws(' ', 'x', w[i], w[i+1], w[i+2], w[i+4], w[i+6], w[i+7]) AS k FROM bp WHERE i + 7 <= len(w)
  UNION ALL SELECT item_id, i, concat_ws(' ', 'y', w[i], w[i+1], w[i+3], w[i+6], w[i+7], w[i+8]) FROM bp WHERE i + 8 <= len(w)
  UNION ALL SELECT item_id, i, concat_ws(' ', n, z, array_to_string([CASE WHEN x = z THEN '' ELSE w[i + x] END FOR x IN range(n)], ' ')) FROM bp, masks WHERE len(w) = n AND i = 1),
al AS (SELECT DISTINCT doc_id, item_id, dk.i - bk.i AS start FROM dk JOIN bk USING (k)),
cells AS (
  SELECT doc_id, item_id, start, len(b.w) AS n, bp.i, CASE WHEN b.w[bp.i] = d.w[start + bp.i] THEN 1 ELSE -1 END AS s
  FROM al JOIN d USING (doc_id) JOIN b USING (item_id) JOIN bp USING (item_id) WHERE start + bp.i BETWEEN 1 AND len(d.w)),
sums AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, item_id, start ORDER BY i) AS c FROM cells),
lows AS (SELECT *, least(0, min(c) OVER (PARTITION BY doc_id, item_id, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low FROM sums),
runs AS (SELECT doc_id, item_id, start, any_value(n) AS n, max(c - coalesce(low, 0)) AS score, count(*) FILTER (s = 1) AS matches FROM lows GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, matches DESC, start) AS pos FROM runs WHERE score >= least(8, ceil(n * 0.6)))
SELECT doc_id, item_id, score::INTEGER AS score, start::INTEGER AS start, matches::INTEGER AS matches FROM best WHERE pos = 1
"""

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's variants are all values within half the radius. Two
fingerprints within the radius share at least one variant, so grouping by
variant finds every pair. Variants are not shuffled one by one (64 bits and
radius 4: 2,081 a fingerprint): a few of their bits form the routing key,
each fingerprint is sent once to every key that one of its variants carries
(with the flips still allowed there), and the receiving task makes the rest
of the variants, sorts them and links equal ones. Keys that too many rows
share are split by further bits before the shuffle. Exact copies collapse to
one fingerprint before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm import tokens
from siftlake.llm.common import forget, release, written
from siftlake.llm.components import components

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 << 8):  # bounded memory for texts of any length
        part = hashes[at : at + (255 << 8)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th independent 64-bit hash derived from a hash; the 0th is itself."""
    if k == 0:
        return hashes
    z = hashes + np.uint64(_MIX[0] * (2 * k + 1) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit SimHash of each whole text as a signed long.

    A null or empty text has fingerprint 0. Other columns are not carried.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.zeros(b.num_rows, np.uint64)
            for lo, _, raw, offsets in tokens.chunks(b.column(1)):
                h, bounds = tokens.shingle_hashes(tokens.words(raw, offsets), words, seed)
                for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    fps[lo + i] = majority(h[x:y])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Ball:
    """Fingerprints of ``bits`` bits that link within ``2 * half`` differing bits."""

    bits: int = 64
    half: int = 2

    def positions(self) -> list[int]:
        """Bit positions in the fixed order in which they route."""
        return [int(p) for p in np.random.default_rng(12345).permutation(self.bits)]

    def route_bits(self, items: int, home: int = 16_000) -> int:
        """How many bits route, so that about ``home`` of the items are at home under one key."""
        return min(self.bits // 2, 24, max(4, math.ceil(math.log2(max(1, items) / home))))

    def copies(self, n: int) -> int:
        """Keys of ``n`` bits that the variants of one fingerprint carry."""
        return sum(math.comb(n, k) for k in range(self.half + 1))

    def routes(self, fp: np.ndarray, n: int, hot: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, flips left) for every routing key that a variant of a fingerprint carries.

        A key is a leading 1 and the values of the first bits in routing
        order; ``hot`` keys are replaced by their extensions.
        """
        busy = np.array(sorted(hot), np.int64)
        stack = [(np.arange(len(fp)), np.ones(len(fp), np.int64), np.full(len(fp), self.half, np.int8), 0, n)]
        rows, keys, flips = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        while stack:
            row, key, left, used, more = stack.pop()
            bits = np.zeros(len(row), np.int64)
            for p in self.positions()[used : used + more]:
                bits = bits << 1 | ((fp[row] >> np.uint64(p)) & np.uint64(1)).astype(np.int64)
            for r in range(self.half + 1):
                own = left == r
                masks = [(sum(1 << i for i in c), r - k) for k in range(r + 1) for c in combinations(range(more), k)]
                m, after = np.array([x for x, _ in masks], np.int64), np.array([x for _, x in masks], np.int8)
                to = (key[own, None] << more | (bits[own, None] ^ m[None, :])).ravel()
                out, rest = np.repeat(row[own], len(m)), np.tile(after, int(own.sum()))
                split = np.isin(to, busy) if len(busy) else np.zeros(len(to), bool)
                rows.append(out[~split])
                keys.append(to[~split])
                flips.append(rest[~split])
                if split.any():
                    stack.append((out[split], to[split], rest[split], used + more, min(4, self.bits - used - more)))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(flips)

    def meet(self, fp: np.ndarray, left: np.ndarray, used: int, span: int = 1, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of rows that share a variant.

        ``used`` routing bits are settled. A group whose variants would not
        fit in ``most`` values is split by further bits, however skewed it
        is. In a variant's group rows at most ``span`` apart are paired, in
        a pseudo-random order: 1 links the group as a chain.
        """
        pos = self.positions()
        stack = [(np.arange(len(fp)), left.astype(np.int8), used)]
        rng = np.random.default_rng(7)
        sizes = lambda u: np.array([sum(math.comb(self.bits - u, k) for k in range(r + 1)) for r in range(self.half + 1)])
        while stack:
            rows, flips, u = stack.pop()
            if len(rows) < 2:
                continue
            if sizes(u)[flips].sum() > most and u < self.bits:
                bit = (fp[rows] >> np.uint64(pos[u])) & np.uint64(1)
                for side in (0, 1):
                    same = bit == side
                    keep = same | (flips > 0)
                    stack.append((rows[keep], np.where(same, flips, flips - 1)[keep].astype(np.int8), u + 1))
                continue
            order = rng.permutation(len(rows))
            rows, flips = rows[order], flips[order]
            settled = np.uint64(sum(1 << p for p in pos[:u]))
            free = [1 << p for p in pos[u:]]
            values, owners = [], []
            for r in range(self.half + 1):
                own = rows[flips == r]
                if len(own):
                    masks = np.array([sum(c) for k in range(r + 1) for c in combinations(free, k)], np.uint64)
                    values.append(((fp[own] & ~settled)[:, None] ^ masks[None, :]).ravel())
                    owners.append(np.repeat(own, len(masks)))
            value, owner = np.concatenate(values), np.concatenate(owners)
            at = np.argsort(value, kind="stable")
            value, owner = value[at], owner[at]
            for s in range(1, span + 1):
                same = np.flatnonzero(value[s:] == value[:-s])
                if not len(same):
                    break
                x, y = owner[same], owner[same + s]
                pair = np.unique(np.minimum(x, y).astype(np.int64) * len(fp) + np.maximum(x, y))
                x, y = pair // len(fp), pair % len(fp)
                yield x[x != y], y[x != y]


def links(fps: DataFrame, ball: Ball = Ball(), home: int = 16_000) -> DataFrame:
    """``(a, b)``: links between different fingerprints, verified, that connect all within the radius.

    ``fps`` has the distinct fingerprints as signed longs in ``fp``. Keys of
    more than four times the usual rows are split by four further bits, until
    none is left; they are fewer than one in 4 * ``home`` fingerprints.
    """
    n = ball.route_bits(fps.count(), home)

    def sent(hot: frozenset[int]) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(fp), 4096):
                    rows, key, left = ball.routes(fp[at : at + 4096], n, hot)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(left), pa.array(fp[at + rows].view(np.int64))], ["key", "flips", "fp"])

        return fps.select("fp").mapInArrow(send, "key long, flips byte, fp long")

    def group(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        found: list[np.ndarray] = [np.zeros((0, 2), np.uint64)]
        for x, y in ball.meet(fp, table.column("flips").to_numpy(), table.column("key")[0].as_py().bit_length() - 1):
            near = np.bitwise_count(fp[x] ^ fp[y]) <= 2 * ball.half
            found.append(np.stack([fp[x][near], fp[y][near]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    hot: frozenset[int] = frozenset()
    most = 4 * home * ball.copies(n)
    while True:
        full = sent(hot).groupBy("key").count().where((F.col("count") > most) & (F.col("key") < 1 << min(ball.bits - 4, 58)))
        more = frozenset(r[0] for r in full.select("key").collect())
        if not more:
            return sent(hot).groupBy("key").applyInArrow(group, "a long, b long")
        hot |= more


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, ball: Ball = Ball()) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every document.

    ``component_id`` is the smallest id reachable over links of at most
    ``2 * ball.half`` differing bits. Null and empty texts share fingerprint
    0 and link like any other; rows with a null id get a component but never
    name one (a component of null ids only has a null name); repeated rows
    stay repeated; an empty table gives an empty one.
    """
    fps = written(fingerprints(docs, doc_id, text, words), "fingerprints")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts, ball)).select(F.col("node").alias("fp"), "root")
    named = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """Sixteen lower-case hexadecimal digits of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_counts(docs: DataFrame, text: str = "text", words: int = 5, bits: int = 22) -> np.ndarray:
    """How often shingles occur, summed over those whose hashes end in the same ``bits`` bits; large numbers are cut off.

    It only orders shingles, so that rare ones come first: any numbers give the same result.
    """
    share = 1 << max(bits - 6, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for _, _, raw, offsets in tokens.chunks(b.column(0)):
                h, _ = tokens.shingle_hashes(tokens.words(raw, offsets), words, 42)
                at, n = np.unique(h & np.uint64((1 << bits) - 1), return_counts=True)
                total[at] += n.astype(np.uint32)
        cut = np.minimum(total, 255).astype(np.uint8)
        parts = [cut[at : at + share].tobytes() for at in range(0, len(cut), share)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint8).astype(np.uint32) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())})

    shape = "part int, counts binary"
    got = docs.select(F.col(text).alias("text")).mapInArrow(run, shape).groupBy("part").applyInArrow(add, shape).collect()
    out = np.zeros(1 << bits, np.uint16)
    for part, counts in got:
        out[part * share : (part + 1) * share] = np.frombuffer(counts, "<u2")
    return out


def prefixes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, text_hash, sig, fp, size, prefix``: a hash of each text's set of shingles, its SimHash, its size and its rarest shingles.

    All texts order shingles alike, rare ones first. The prefix is so long
    that two sets of the given Jaccard similarity or more have a shingle of
    their prefixes in common. ``sig`` is null for texts without words.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text, words))
    names = ["doc_id", "text_hash", "sig", "fp", "size", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        mask = np.uint64(len(often) - 1)
        for b in batches:
            sig: list[int | None] = []
            fp: list[int] = []
            size: list[int] = []
            prefix: list[np.ndarray] = []
            for _, _, raw, offsets in tokens.chunks(b.column(2)):
                h, bounds = tokens.shingle_hashes(tokens.words(raw, offsets), words, 42)
                for x, y in zip(bounds, bounds[1:], strict=False):
                    own = np.unique(h[x:y])
                    n = len(own)
                    first = n - math.ceil(similarity * n - 1e-6) + 1 if n else 0
                    prefix.append(own[np.lexsort((own, often[own & mask]))[:first]].view(np.int64))
                    size.append(n)
                    fp.append(majority(own))
                    sig.append(int((remix(own, 11).sum(dtype=np.uint64) ^ remix(np.array([n], np.uint64), 12)[0]).view(np.int64)) if n else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sig, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], names
            )

    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, text_hash long, sig long, fp long, size int, prefix array<long>")


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """``sig, shingles`` from ``sig, text``: the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in tokens.chunks(b.column(1)):
                h, bounds = tokens.shingle_hashes(tokens.words(raw, offsets), words, 42)
                sets = [np.unique(h[x:y]).view(np.int64) for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], ["sig", "shingles"])

    return docs.select("sig", "text").mapInArrow(run, "sig long, shingles array<long>")


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """``shingle, sig, size, at, low, low_size`` of prefix shingles that several sets have; ``low`` is the next smaller set of the shingle."""
    each = nodes.select("sig", "size", F.posexplode("prefix").alias("at", "shingle"))
    by = Window.partitionBy("shingle").orderBy("size", "sig")
    beside = each.select("shingle", "sig", "size", "at", F.lag("sig").over(by).alias("low"), F.lag("size").over(by).alias("low_size"), F.lead("sig").over(by).alias("high"))
    return beside.where("low IS NOT NULL OR high IS NOT NULL").drop("high")


def open_pairs(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all pairs of sets that may be similar and are not connected by ``roots`` (``node, root``).

    Every two sets with a common prefix shingle are paired, unless their
    sizes or the places of the shingle leave too few others in common.
    """
    placed = shared.select("shingle", "sig", "size", "at").join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("shingle").agg(F.min("root").alias("m"), F.max("root").alias("n")).where("m <> n").select("shingle")
    rows = written(placed.join(mixed, "shingle", "left_semi"), "open")
    forget(placed)
    x, y = rows.alias("x"), rows.alias("y")
    order = F.expr("x.shingle = y.shingle AND (x.size < y.size OR (x.size = y.size AND x.sig < y.sig)) AND x.root <> y.root")
    size = F.col("x.size") >= F.lit(similarity) * F.col("y.size") - 1e-6
    need = F.lit(similarity / (1 + similarity)) * (F.col("x.size") + F.col("y.size")) - 1e-6
    place = F.expr("least(x.size - x.at, y.size - y.at)") >= need
    return x.join(y, order & size & place).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()


def hashed_pairs(nodes: DataFrame, ball: Ball = Ball()) -> DataFrame:
    """``a, b``: sets that SimHash proposes, from ``sig, fp``: those of linked fingerprints, each by its smallest set, and of equal ones."""
    firsts = nodes.groupBy("fp").agg(F.min("sig").alias("first"))
    near = written(links(firsts, ball), "balls")
    first = lambda side: firsts.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_sig"))
    apart = near.join(first("a"), "a").join(first("b"), "b").select("a_sig", "b_sig")
    equal = nodes.join(firsts, "fp").where("sig <> first").select("first", "sig")
    both = apart.union(equal)
    return both.select(F.least(*both.columns).alias("a"), F.greatest(*both.columns).alias("b"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id.

    Groups are connected by pairs whose sets of shingles have a Jaccard
    similarity of at least ``similarity``. SimHash and its ball join propose
    pairs, but at such similarities fingerprints differ by more bits than a
    ball can hold, so an exact search completes them: each pair shares a
    shingle of its prefixes. Pairs of SimHash and neighbours in size under a
    shingle are verified first; then all other pairs that those links leave
    unconnected. Null texts and texts without words are never grouped. Of
    repeated rows of an id and text one stays; null ids come before others,
    ties go by text hash. An empty table gives an empty one; other columns
    are carried, whatever their names.
    """
    spark = docs.sparkSession
    row = F.struct("doc_id", "text_hash")
    # Prefixes are the bulk of what is kept, so each table that has them goes as soon as the next is there.
    full = written(prefixes(docs, doc_id, text, words, similarity), "prefixes")
    have = written(full.where("sig IS NOT NULL").select("doc_id", "text_hash", "sig"), "rows")
    whole = written(
        full.where("sig IS NOT NULL").groupBy("sig").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.min(row).alias("low")), "nodes"
    )
    forget(full)
    release(spark)
    shared = written(shared_prefixes(whole), "shared")
    nodes = written(whole.drop("prefix"), "nodes")
    forget(whole)
    release(spark)
    # One key that is never null, so that rows of a document meet in one partition and need no second shuffle to be told apart.
    given = docs.select(F.col(doc_id).alias("__own"), F.col(text).alias("text"), F.xxhash64(text).alias("__text"))
    given = given.withColumn("__key", F.xxhash64("__own", "__text"))

    def similar(pairs: DataFrame, what: str) -> DataFrame:
        pairs = written(pairs.distinct(), "pairs")
        used = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        wanted = nodes.join(used, "sig").select("sig", F.col("low.doc_id").alias("__id"), F.col("low.text_hash").alias("__hash"))
        wanted = wanted.withColumn("__key", F.xxhash64("__id", "__hash"))
        same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
        texts = given.join(wanted, "__key").where(same).dropDuplicates(["__key", "sig"]).select("sig", "text")
        sets = written(shingle_sets(texts, words), "sets")
        release(spark)
        both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        counted = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n"))
        out = written(counted.where(F.col("c") >= F.lit(similarity) * (F.col("n") - F.col("c"))).select("a", "b"), what)
        forget(pairs, sets)
        release(spark)
        return out

    beside = shared.where(F.col("low_size") >= F.lit(similarity) * F.col("size") - 1e-6).select(F.least("low", "sig").alias("a"), F.greatest("low", "sig").alias("b"))
    near = similar(beside.unionByName(hashed_pairs(nodes.select("sig", "fp"))), "near")
    linked = near.unionByName(similar(open_pairs(shared, components(near), similarity), "far"))
    forget(shared)
    roots = components(linked)
    release(spark)
    named = nodes.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").select("sig", "low", F.coalesce("root", "sig").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("keep"))
    kept = named.join(lowest, "root").select("sig", "keep")
    gone = have.join(kept, "sig").where(~row.eqNullSafe(F.col("keep"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own, hashed = F.col(doc_id), F.xxhash64(text)
    out = docs.join(gone, own.eqNullSafe(F.col("__id")) & (hashed == F.col("__hash")), "left_anti")
    again = have.groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.isEmpty():
        return out
    twice = again.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = own.eqNullSafe(F.col("__id")) & (hashed == F.col("__hash"))
    return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates([doc_id, text]))

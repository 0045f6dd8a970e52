"""Jaccard join of n-gram sets: size-aware, heavy and light, to connected components.

Sets are the distinct hashed word shingles of a text; equal sets are one
node. Two nodes link when the intersection is at least ``PERCENT`` percent of
the union. With t the threshold, a set of n shingles shares at least
ceil(t n) of them with any partner, so it misses at most floor((1 - t) n).

Light sets (up to a boundary) send every subset of ceil(t n) to n shingles.
Two sets link exactly if they share a subset large enough for both, so these
links need no check. Heavy sets are looked up in inverted lists of their
n - ceil(t n) + 1 rarest shingles (prefix filter); pairs found there are
checked on the whole sets. The boundary is the size at which sending subsets
costs more than scanning lists of the measured mean length; sets between it
and boundary / t do both.

First of all one pass tells each block which of its shingles occur anywhere
else. A set with fewer than ceil(t n) such shingles has no partner and takes
no further part. Within a list not all pairs are made: its members are compared
with one member of each size class, then those outside the list's largest
component with drawn members of it, and components are formed in between. What
is left is compared in full: members of different components whose sizes
and places in the list allow a link. Links inside a component change nothing, so
the components are exact.

Null and empty texts have an empty set and are alone. Repeated rows are
copies. A null doc_id takes part; the component's id is the smallest doc_id
present (null if there is none). An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.blocks import FILTER, Answers, Blocks, Docs, distinct, first_of_each, write_blocks
from relyframe.llm.common import U, Rolling, Words, mix
from relyframe.session import scratch_path

SHINGLE = 5
PERCENT = 80
#: Largest sets that may send subsets; the boundary is chosen below it by cost.
LIGHT_MAX = 14
#: Rounds in which members of a list try drawn members of its largest component, and draws for different lists.
ROUNDS, DRAWS = 1, 4
PREFIX, SUBSET, SET, DOC = 0, 1, 2, 3
ROW = "doc_id long, k1 long, k2 long, node long, n int, key long, size int, common int, data binary, kind int"


def need(n, percent: int = PERCENT):
    """ceil(t n): what a set of n shares with any partner at least."""
    return -(-percent * n // 100)


class Sets:
    """The shingle sets of one block, one after another."""

    def __init__(self, docs: Docs, size: int):
        self.docs = docs
        w = Words(docs.blob, docs.starts, docs.lens, lower=True)
        at, h = w.windows(size)
        doc = w.doc[at]
        few = np.flatnonzero((w.count > 0) & (w.count < size))
        if len(few):  # the whole sequence is the one shingle
            h = np.concatenate((h, Rolling(w.hash).windows(w.first[few], w.count[few])))
            doc = np.concatenate((doc, few))
        pair = np.lexsort((h, doc))
        doc, h = doc[pair], h[pair]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        self.doc, self.hash = doc[new], h[new]
        self.n = np.bincount(self.doc, minlength=len(docs.ids))
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.node = mix(self._sum(self.hash) + mix(self._sum(mix(self.hash ^ U(0x5851F42D4C957F2D))) + self.n.astype(U)))
        some = np.flatnonzero(self.n)
        self.single = np.zeros(len(self.n), bool)
        self.single[some[first_of_each(self.node[some])]] = True
        self.rows = self.single[self.doc]

    def _sum(self, values):
        total = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def first_pass(self):
        return [(FILTER, np.unique(self.hash[self.rows]), None)]

    def shared(self, answers: Answers) -> tuple[np.ndarray, np.ndarray]:
        """Rarity class (0 none but this set, 1, 2) of each shingle of a single set, and which sets can have a partner."""
        keys, inverse, times = distinct(self.hash[self.rows])
        tie, many = answers.of(FILTER, keys)
        level = np.zeros(len(self.hash), np.int8)
        level[self.rows] = ((tie | (times > 1)).astype(np.int8) + many)[inverse]
        common = np.bincount(self.doc[level > 0], minlength=len(self.n))
        return level, common


def signatures(blocks: Blocks, answers: DataFrame, size: int, percent: int, light: int) -> DataFrame:
    """Rows of ROW: each document, and of sets that can have a partner the set, its prefix and its subsets."""
    also = light * 100 // percent  # partners of light sets

    def run(docs: Docs, a: Answers) -> pa.Table:
        s = Sets(docs, size)
        level, common = s.shared(a)
        nodes = s.node.view(np.int64)
        out = [[] for _ in range(7)]

        def add(node, n, key, of, common, data, kind):
            for c, v in zip(out, (node, n, key, of, common, data, kind)):
                c.append(v)

        for i in np.flatnonzero(s.single & (common >= need(s.n, percent))).tolist():
            lo, hi = s.first[i], s.first[i + 1]
            n, h, lev, node = int(s.n[i]), s.hash[lo:hi], level[lo:hi], int(nodes[i])
            if n > light:
                add(node, n, None, None, None, h.tobytes(), SET)
                rare = np.lexsort((h, lev))[: n - need(n, percent) + 1]
                place = np.flatnonzero(lev[rare] > 0)
                for at, key in zip(place.tolist(), h[rare[place]].view(np.int64).tolist()):
                    add(node, n, key, at, int(common[i]), None, PREFIX)
            if n <= also:
                alone = np.flatnonzero(lev == 0).tolist()
                can = np.flatnonzero(lev > 0).tolist()
                for k in range(len(alone), n - need(n, percent) + 1):
                    for gone in combinations(can, k - len(alone)):
                        left = np.delete(h, [*alone, *gone])
                        total = mix(np.array([left.sum(dtype=U) + mix(left).sum(dtype=U) * U(3)], U) + U(n - k))
                        add(node, n, int(total.view(np.int64)[0]), n - k, None, None, SUBSET)
        k, d = len(out[0]), len(docs.ids)
        none = pa.nulls(d, pa.int64())
        return pa.table([
            *[pa.concat_arrays([x.cast(pa.int64()), pa.nulls(k, pa.int64())])
              for x in (docs.id_array(), pa.array(docs.k1), pa.array(docs.k2))],
            pa.concat_arrays([pa.array(nodes), pa.array(out[0], pa.int64())]),
            pa.concat_arrays([pa.array(s.n.astype(np.int32)), pa.array(out[1], pa.int32())]),
            pa.concat_arrays([none, pa.array(out[2], pa.int64())]),
            pa.concat_arrays([pa.nulls(d, pa.int32()), pa.array(out[3], pa.int32())]),
            pa.concat_arrays([pa.nulls(d, pa.int32()), pa.array(out[4], pa.int32())]),
            pa.concat_arrays([pa.nulls(d, pa.binary()), pa.array(out[5], pa.binary())]),
            pa.concat_arrays([pa.array([DOC] * d, pa.int32()), pa.array(out[6], pa.int32())])],
            names=[c.split()[0] for c in ROW.split(", ")])

    return blocks.each(run, ROW, answers)


def boundary(answers: DataFrame, percent: int) -> int:
    """Largest size for which all subsets cost at most the prefix and its lists (of the mean length found)."""
    r = answers.agg(F.sum("entries").alias("e"), F.sum("lists").alias("l")).first()
    length = (r["e"] or 0) / max(r["l"] or 0, 1)
    best = 0
    for n in range(1, LIGHT_MAX + 1):
        m = n * 100 // percent  # the largest partner also sends subsets
        subsets = sum(comb(m, k) for k in range(m - need(m, percent) + 1))
        if subsets <= (n - need(n, percent) + 1) * (1 + length):
            best = n
    return best


def _written(df: DataFrame, name: str) -> DataFrame:
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): alternating large and small stars, each round written."""
    spark = edges.sparkSession
    edges = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a != b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = _written(large.distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = _written(small.where("a != b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    ends = edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("data").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("data").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def light_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links by shared subsets: each member of a bucket with its smallest set, if the subset is enough for both."""
    sub = rows.where(F.col("kind") == SUBSET).select("key", "size", "n", "node").distinct()
    least = sub.groupBy("key", "size").agg(F.min(F.struct("n", "node")).alias("c"), F.count("*").alias("k")).where("k > 1")
    pairs = sub.join(least, ["key", "size"]).where(F.col("node") != F.col("c.node"))
    enough = 100 * F.col("size") >= percent * (F.col("n") + F.col("c.n") - F.col("size"))
    return pairs.where(enough).select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()


def _placed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists that hold more than one component, with each member's component and the list's largest."""
    placed = lists.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = _written(placed, "placed")
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("k"))
    top = per.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    return placed.join(top.where("comps > 1").select("key", "top"), "key")


def heavy_links(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links by inverted lists, checked; ``known`` are the links that are there already.

    If a shingle is the first in the order of rarity that two sets share, at
    places i and j of n and m, they share at most min(n - i, m - j). So a set can
    have partners of at most ``most`` shingles in that list, a bound that is below
    n itself for all sets but those that are nearly the same. Of two sets that
    link, at least one has a bound of its own size or more ("open"): pairs
    without an open set are never made.
    """
    lists = rows.where(F.col("kind") == PREFIX).select("key", "n", "node", F.col("size").alias("place"), "common").distinct()
    sets = rows.where(F.col("kind") == SET).groupBy("node").agg(F.first("data").alias("data"))
    shared = F.expr(f"({100 + percent} * (n - place)) div {percent}")
    lists = lists.withColumn("most", shared - F.col("n")).withColumn("open", F.col("most") >= F.col("n"))
    use = lists.groupBy("key").agg(F.count("*").alias("k"), F.count_if("open").alias("o"), F.min("n").alias("least"))
    lists = lists.join(use.where("k > 1 and o > 0"), "key").where("most >= least").drop("k", "o", "least")
    lists = _written(lists, "lists")
    sets = _written(sets.join(lists.select("node").distinct(), "node", "left_semi"), "sets")
    # members against one open member of their size class: the one with the largest share of shingles
    # that occur elsewhere, in a group of near copies the one that was changed least
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    banded = lists.withColumn("band", band)
    draw = F.xxhash64("node", F.pmod("key", F.lit(DRAWS)))
    centre = banded.where("open").groupBy("key", "band").agg(
        F.max(F.struct((F.col("common") / F.col("n")).alias("share"), draw.alias("draw"), "node", "n", "most")).alias("c"))
    star = banded.join(centre, ["key", "band"]).where(
        (F.col("node") != F.col("c.node")) & (F.col("n") <= F.col("c.most")) & (F.col("c.n") <= F.col("most")))
    tried = _written(star.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct(), "tried")
    links = _written(verified(tried, sets, percent), "links")
    # most members of a group of near copies link with many of the others: those outside a list's
    # largest component try some members of it, drawn anew in each round
    for turn in range(ROUNDS):
        placed = _placed(lists, known.unionByName(links))
        draw = F.xxhash64("node", F.pmod("key", F.lit(DRAWS)), F.lit(turn))
        centre = placed.where("open and comp = top").groupBy("key").agg(
            F.min(F.struct(draw.alias("draw"), "node", "n", "most")).alias("c"))
        more = placed.where("comp != top").join(centre, "key").where(
            (F.col("n") <= F.col("c.most")) & (F.col("c.n") <= F.col("most")))
        more = more.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
        more = _written(more.join(tried, ["a", "b"], "left_anti"), "tried")
        tried = tried.unionByName(more)
        links = links.unionByName(_written(verified(more, sets, percent), "links"))
    # then all pairs of members of different components that are left: an open one outside the
    # list's largest component with all others, an open one inside it with those outside
    placed = _placed(lists, known.unionByName(links))
    left = placed.where("open").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"),
                                       F.col("comp").alias("ca"), (F.col("comp") == F.col("top")).alias("ta"))
    right = placed.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"),
                          F.col("comp").alias("cb"), (F.col("comp") == F.col("top")).alias("tb"), F.col("open").alias("ob"))
    may = (F.col("ca") != F.col("cb")) & (F.col("nb") <= F.col("ma")) & (F.col("na") <= F.col("mb"))
    once = ~F.col("ob") | F.col("tb") | (F.col("a") > F.col("b"))  # a pair of open sets outside comes from both sides
    outside = left.where("not ta").join(right, "key").where(may & once)
    inside = left.where("ta").join(right.where("not tb and not ob"), "key").where(may)
    pairs = outside.select("a", "b").unionByName(inside.select("a", "b")).distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti").join(
        tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    return links.unionByName(verified(pairs, sets, percent))


def join_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, light: int | None = None) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id, n_copies (documents with the same set), component, by row of ``docs``.

    ``component`` is null for empty sets.
    """
    spark: SparkSession = docs.sparkSession
    blocks = write_blocks(docs)
    answers = blocks.answer(blocks.ask(lambda d: Sets(d, size).first_pass()))
    light = boundary(answers, percent) if light is None else light
    at = scratch_path(spark, "signatures")
    signatures(blocks, answers, size, percent, light).write.partitionBy("kind").parquet(at)
    rows = spark.read.schema(ROW).parquet(at)
    small = _written(light_links(rows, percent), "light-links")
    links = small.unionByName(heavy_links(rows, small, percent))
    comp = components(links)
    own = rows.where(F.col("kind") == DOC).select("doc_id", "k1", "k2", "node", "n")
    per = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    per = per.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = per.groupBy("comp").agg(F.min("least").alias("component_id"))
    per = per.join(least, "comp").select("node", "component_id", "n_copies", "comp")
    alone = F.col("n") == 0
    return own.join(per, "node", "left").select(
        "doc_id", "k1", "k2", F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.col("comp").alias("component"))

"""Embedding near-dedup: a forest of random-projection trees with spill, exact checks within leaves, union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, map_arrow

COSINE = 0.98
TREES = 16
#: Both sides of a split keep what lies this near to its threshold (unit vectors at cosine 0.98 are 0.2 apart, so 0.025 is typical along one of 64 directions).
SPILL = 0.03
#: From this level on the spill shrinks as 1 / level, so that a row's copies in a tree grow with a small power of the depth (about 6 at a billion rows), not exponentially with it.
FULL_LEVELS = 4
LEAF_ROWS = 400
#: Documented bound of the sample on which thresholds are fitted; all rows are indexed.
SAMPLE = 20_000
#: Rows of a leaf compared with each other at once; a larger leaf is compared in pairs of such blocks.
BLOCK_ROWS = 1024


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 11) -> list[dict]:
    """Trees of random unit directions, one per level, and thresholds near the median of the sample in each node.

    The depth follows the number of rows to index, not the sample: below
    nodes with few sample rows the level's own median serves.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(1, rows / LEAF_ROWS)))))
    forest = []
    for _ in range(trees):
        way = rng.normal(size=(depth, dim))
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        node, cuts, common = np.zeros(len(sample), np.int64), [], []
        for level in range(depth):
            x = sample @ way[level]
            common.append(float(np.median(x)))
            own = {}
            order = np.argsort(node, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if len(part) >= 32:
                    own[int(node[part[0]])] = float(np.quantile(x[part], rng.uniform(0.4, 0.6)))
            cuts.append(own)
            node = node * 2 + (x >= np.array([own.get(int(n), common[-1]) for n in node]))
        forest.append({"way": way, "cuts": cuts, "common": common})
    return forest


def spill_at(level: int, spill: float = SPILL) -> float:
    """Spill of a level: whole in the first FULL_LEVELS, then falling, which more levels make up for less than the trees do."""
    return spill * min(1.0, FULL_LEVELS / (level + 1))


def leaves(tree: dict, x: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs: every leaf of the tree that a row falls in, spill included."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(len(tree["way"])):
        y = (x @ tree["way"][level])[row]
        own, common = tree["cuts"][level], tree["common"][level]
        kinds, inverse = np.unique(node, return_inverse=True)
        t = np.array([own.get(int(k), common) for k in kinds])[inverse]
        reach = spill_at(level, spill)
        left, right = y < t + reach, y >= t - reach
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
    return row, node


def _vectors(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.values.slice(column.offsets[0].as_py(), column.offsets[len(column)].as_py() - column.offsets[0].as_py()), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, label, n_links, component_id, kept) for every row of embeddings (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine, in
    double precision, is at least `cosine`; every reported link is checked.
    Vectors that are null, zero, of another length than most, or hold null or
    non-finite components link with nothing. Equal vectors of a label are one
    class with a count, so copies make no pairs. A leaf is a group of classes
    of one label; it is compared in blocks of bounded size, and what leaves
    it are counts of links and edges of a spanning forest, not pairs. A link
    seen in several leaves counts in the first of them alone, which each row's
    own list of leaves tells. Rows that repeat a vec_id are rows of their own.
    An empty table gives an empty one.
    """
    spark = embeddings.sparkSession
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (norm2 > 0)
    sound = base.where(F.coalesce(fine, F.lit(False)))
    size = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return base.select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = F.coalesce(fine, F.lit(False)) & (F.size("v") == size["n"])
    classes = cut(base.where(usable).groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low")).withColumn("id", F.xxhash64("label", "v")), "emb-classes")
    rows = classes.count()
    picked = classes.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = np.array(picked.tolist(), dtype=np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    per_label = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    forest = fit_forest(sample, max(per_label, rows // 64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(2))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            found: list[list[list[int]]] = [[] for _ in range(len(x))]
            every = []
            for t, tree in enumerate(forest):
                row, leaf = leaves(tree, x)
                every.append((row, leaf * len(forest) + t))
            row, leaf = (np.concatenate(z) for z in zip(*every))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            ends = np.searchsorted(row, np.arange(len(x) + 1))
            found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(leaf))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64())), b.column(3), found], names=["id", "label", "unit", "copies", "leaves"])

    indexed = cut(map_arrow(classes.select("id", "label", "v", "copies"), place, "id long, label string, unit array<double>, copies long, leaves array<long>"), "emb-index")
    # Leaf sizes; a row's block within a leaf comes from its hash, so that any leaf is dealt out.
    placed = indexed.select("id", "label", "unit", "copies", "leaves", F.explode("leaves").alias("leaf"))
    sizes = placed.groupBy("label", "leaf").agg(F.count("*").alias("n")).where("n > 1").select("label", "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["label", "leaf"]).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    # Block pairs (i <= j): each row goes to all pairs that hold its block, as often as there are blocks.
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = pairs.select("label", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "unit", "copies", "leaves")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x = np.array(group["unit"].to_pylist())
        ids, copies = np.asarray(group["id"]), np.asarray(group["copies"])
        block, (leaf, i, j) = np.asarray(group["block"]), (int(k.as_py()) for k in key[1:4])
        tree = leaf % TREES
        flat = group["leaves"].combine_chunks()
        at, ends = np.asarray(flat.values), np.asarray(flat.offsets)
        owner = np.repeat(np.arange(len(x)), np.diff(ends))
        at = at[ends[0] : ends[-1]]
        slot = np.lexsort((at, at % TREES, owner))
        owner, at = owner[slot], at[slot]
        nth = np.arange(len(at)) - np.searchsorted(owner * TREES + at % TREES, owner * TREES + at % TREES)
        trees = np.full((len(x), TREES, int(nth.max()) + 1), -1, np.int64)
        trees[owner, at % TREES, nth] = at
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        if i != j:
            a, b = (z[block[a] != block[b]] for z in (a, b))
        for t in range(tree + 1):  # a link counts in the first tree where its rows share a leaf, and in the smallest such leaf
            mine = np.ones(len(a), bool)
            for lo in range(0, len(a), 1 << 16):
                p, q = trees[a[lo : lo + (1 << 16)], t], trees[b[lo : lo + (1 << 16)], t]
                same = (p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)
                least = np.where(same, p[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
                mine[lo : lo + (1 << 16)] = least == leaf if t == tree else least == np.iinfo(np.int64).max
            a, b = a[mine], b[mine]
        n = np.zeros(len(x), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        label = np.arange(len(x))
        while len(a):  # the smallest row that each reaches within this group
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            if (before == label).all():
                break
        some, star = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"id": np.concatenate([ids[some], ids[star]]), "links": np.concatenate([n[some], np.zeros(len(star), np.int64)]), "other": np.concatenate([ids[some], ids[label[star]]])})

    found = cut(tasks.groupBy("label", "leaf", "i", "j").applyInArrow(compare, "id long, links long, other long"), "emb-links")
    counts = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.where("links = 0").select(F.col("id").alias("a"), F.col("other").alias("b")), "emb-components")
    joined = classes.select("label", "v", "id", "low", "copies").join(counts, "id", "left").join(comps, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    lowest = joined.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    classed = joined.join(lowest, F.col("root") == F.col("r")).select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    all_rows = base.withColumn("k", F.when(usable, F.xxhash64("label", "v")))
    out = all_rows.join(classed.withColumn("k2", F.xxhash64("label", "v")).drop("label", "v"), F.col("k") == F.col("k2"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "label", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))

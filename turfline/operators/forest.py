"""Random forests over many rows.

``Forest`` is Spark's ``RandomForestRegressor``: same parameters, same model. Few rows are fitted by Spark's own
trainer. It takes a row through all trees before the next, so each update of a node's statistics misses
the caches, and its partitions each send the statistics of all nodes. From ``MANY_ROWS`` rows on the same
procedure (bins from a sample, Poisson bags, a random subset of the features for each node, the split
with the best gain in variance) runs tree by tree over blocks of binned rows. Its random numbers are its own: a row's
count in the bag of a tree is a hash of row and tree, so a task that runs again draws the same.

A level of all trees is one job: blocks send the sums of their bins by tree, the trees are dealt to tasks
that add them up and find the splits, and the driver holds the trees, whose size does not depend on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.session import give_back, ship_package, stored, stored_path

#: Rows from which a forest is fitted here, and the deepest trees that are (a level's nodes are held side by side).
MANY_ROWS, MOST_LEVELS = 50_000, 10
#: Rows of a block, whose sums a task sends for each tree, and of the slices in which it adds them up.
BLOCK_ROWS, SLICE_ROWS = 250_000, 65_536
#: A split must tell apart rows by more than rounding (Spark's ``Utils.EPSILON``).
EPSILON = 2.0 ** -52
_COUNTED, _BINNED = "n", "binned"


class Forest(RandomForestRegressor):
    """Spark's regressor, for any number of rows."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        rows = dataset.count()
        return fit_forest(self, dataset, rows) if rows >= MANY_ROWS and _covered(self) else super()._fit(dataset)

    def by_spark(self, dataset: DataFrame) -> RandomForestRegressionModel:
        return super()._fit(dataset)


def _covered(est: RandomForestRegressor) -> bool:
    """Whether ``fit_forest`` knows all parameters that are set (other ones are left to Spark)."""
    return (est.getMaxDepth() <= MOST_LEVELS and est.getSubsamplingRate() == 1.0 and est.getBootstrap() and est.getMaxBins() <= 256
            and est.getMinWeightFractionPerNode() == 0.0 and not est.isSet(est.weightCol))


def subset_size(strategy: str, features: int, trees: int) -> int:
    """Features that a node looks at, by Spark's ``featureSubsetStrategy`` for regression."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    sizes = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))),
             "onethird": math.ceil(features / 3.0)}
    if strategy in sizes:
        return sizes[strategy]
    return min(int(strategy), features) if strategy.isdigit() else math.ceil(float(strategy) * features)


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature is split, from a sample of its values: between all neighbours if they are few, otherwise
    about a stride of rows apart (Spark's rule)."""
    found, counts = np.unique(values, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = len(values) / bins
    out, upto, target = [], np.cumsum(counts), stride
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


# ---------------------------------------------------------------- rows

def _binned(dataset: DataFrame, features: str, label: str, cuts: list[np.ndarray]) -> DataFrame:
    """y, a number for each row, and its features' bins as bytes."""
    wide = dataset.select(F.col(label).cast("double").alias("y"), F.monotonically_increasing_id().alias(_COUNTED),
                          vector_to_array(F.col(features)).alias("x"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if not np.isfinite(x).all() or np.isnan(y).any():
                raise ValueError("features and labels of a forest must be numbers")
            bins = np.empty(x.shape, dtype=np.uint8)
            for i, at in enumerate(cuts):
                bins[:, i] = np.searchsorted(at, x[:, i], side="left")
            rows = pa.Array.from_buffers(pa.binary(len(cuts)), batch.num_rows, [None, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(y), batch.column(1), rows.cast(pa.binary())], names=["y", _COUNTED, _BINNED])

    ship_package(dataset.sparkSession)
    return wide.mapInArrow(place, f"y double, {_COUNTED} long, {_BINNED} binary")


def _mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Limits of a 32-bit number for the counts 1, 2, ... of a Poisson variable with mean 1.
_POISSON = np.array([min(2 ** 32 - 1, round(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))) for k in range(12)], dtype=np.uint32)


def in_bag(numbers: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (by its number) is in the bag of a tree: Poisson with mean 1."""
    salt = _mixed(np.array([(seed % 2 ** 32) * 2 ** 32 + tree + 1], dtype=np.uint64))[0]
    u = (_mixed((numbers + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ salt) >> np.uint64(32)).astype(np.uint32)
    count = np.zeros(len(u), dtype=np.uint8)
    for limit in _POISSON:
        count += u >= limit
    return count


# ---------------------------------------------------------------- trees

@dataclass
class Trees:
    """All trees as heaps: node 1 is the root, the children of i are 2i and 2i + 1.

    ``feature`` is -1 where a node is not split (a leaf, or none); ``stats`` are count, sum and sum of squares."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    impurity: np.ndarray
    stats: np.ndarray
    valid: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        shape = (trees, 2 ** (depth + 1))
        return cls(np.full(shape, -1, dtype=np.int64), np.full(shape, 255, dtype=np.uint8), np.full(shape, -1.0), np.full(shape, -1.0),
                   np.zeros((*shape, 3)), np.ones(shape, dtype=bool))


def _variance(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def best_splits(sums: np.ndarray, least: int, min_gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node of ``sums`` (3, nodes, features, bins): which feature and bin give the best gain, that gain (-inf if no
    split keeps ``least`` rows on either side), and the sums left of the split. The first of equal gains counts."""
    upto = np.cumsum(sums, axis=3)
    left, right = upto[..., :-1], upto[..., -1:] - upto[..., :-1]
    total = upto[:, :, :1, -1:]
    impurity, n = _variance(*total), total[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity - left[0] / n * _variance(*left) - right[0] / n * _variance(*right)
    gain = np.where((left[0] >= least) & (right[0] >= least) & (gain >= min_gain), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    feature, at = np.divmod(best, gain.shape[2])
    node = np.arange(len(flat))
    return feature, at, flat[node, best], left[:, node, feature, at].T


_LEVEL = "tree int, part int, sums binary"
_FOUND = "tree int, feature binary, bin binary, gain binary, total binary, left_ binary"


def _level_sums(level: int, feature: np.ndarray, split: np.ndarray, slots: np.ndarray, subsets: list[np.ndarray], bins: int, seed: int):
    """The step that adds up a block's rows by node, feature and bin, for the active nodes of a level of each tree.

    ``slots``: for a tree and a node of the level its place among the tree's active ones, or -1; ``subsets``: their features."""
    from pyspark import TaskContext

    route, limit = np.where(feature < 0, 0, feature), split.astype(np.int64)

    def add(block: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        y = np.concatenate([b.column(0).to_numpy() for b in block])
        numbers = np.concatenate([b.column(1).to_numpy() for b in block]).astype(np.uint64)
        rows = np.concatenate([np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8) for b in block]).reshape(len(y), -1)
        width = rows.shape[1]
        flat, yy = rows.ravel(), y * y
        for tree, subset in enumerate(subsets):
            if not len(subset):
                continue
            nodes, k = subset.shape
            sums = np.zeros((3, k, nodes * bins))
            looked = np.ascontiguousarray(subset.T).astype(np.int64)
            for at in range(0, len(y), SLICE_ROWS):
                part_rows = slice(at, at + SLICE_ROWS)
                count = in_bag(numbers[part_rows], tree, seed)
                here = np.flatnonzero(count > 0)
                first = (here + at) * width
                heap = np.ones(len(here), dtype=np.int64)
                for _ in range(level):
                    over = flat[first + route[tree][heap]] > limit[tree][heap]
                    heap += heap
                    heap += over
                slot = slots[tree][heap - 2 ** level]
                if (slot < 0).any():
                    some = slot >= 0
                    here, first, slot = here[some], first[some], slot[some]
                w = count[here].astype(np.float64)
                wy, wyy = w * y[here + at], w * yy[here + at]
                base = slot * bins
                for j in range(k):
                    key = base + flat[first + looked[j][slot]]
                    sums[0, j] += np.bincount(key, w, nodes * bins)
                    sums[1, j] += np.bincount(key, wy, nodes * bins)
                    sums[2, j] += np.bincount(key, wyy, nodes * bins)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
                                             names=["tree", "part", "sums"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, n = TaskContext.get().partitionId(), [], 0
        try:
            for batch in batches:
                block.append(batch)
                n += batch.num_rows
                if n >= BLOCK_ROWS:
                    yield from add(block, part)
                    block, n = [], 0
            if n:
                yield from add(block, part)
        finally:
            give_back()

    return step


def _level_splits(subsets_shape: list[tuple[int, int]], bins: int, least: int, min_gain: float):
    """The step that adds up the blocks' sums of a tree (they come sorted by tree) and finds its splits."""

    def found(tree: int, sums: np.ndarray) -> pa.RecordBatch:
        nodes, k = subsets_shape[tree]
        sums = sums.reshape(3, k, nodes, bins).transpose(0, 2, 1, 3)
        feature, at, gain, left = best_splits(sums, least, min_gain)
        total = sums[:, :, 0, :].sum(axis=2).T
        parts = [feature.astype(np.int64), at.astype(np.int64), gain, np.ascontiguousarray(total), np.ascontiguousarray(left)]
        return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                                          names=["tree", "feature", "bin", "gain", "total", "left_"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sums = None, None
        for batch in batches:
            for tree, one in zip(batch.column(0).to_pylist(), batch.column(2)):
                values = np.frombuffer(one.as_buffer(), dtype=np.float64)
                if tree == here:
                    sums += values
                    continue
                if here is not None:
                    yield found(here, sums)
                here, sums = tree, values.copy()
        if here is not None:
            yield found(here, sums)

    return step


def grow(rows: DataFrame, features: int, bins: int, trees: int, depth: int, looked_at: int, least: int, min_gain: float, seed: int) -> Trees:
    """Trees over binned ``rows`` (of ``_binned``), a level of all of them at a time."""
    spark = rows.sparkSession
    ship_package(spark)
    out = Trees.empty(trees, depth)
    active = [np.array([1]) for _ in range(trees)]
    for level in range(depth):
        rng = np.random.default_rng([seed % 2 ** 63, level])
        subsets = [rng.random((len(a), features)).argsort(axis=1, kind="stable")[:, :looked_at] for a in active]
        slots = np.full((trees, 2 ** level), -1, dtype=np.int64)
        for tree, nodes in enumerate(active):
            slots[tree, nodes - 2 ** level] = np.arange(len(nodes))
        growing = sum(len(a) > 0 for a in active)
        if not growing:
            break
        sums = rows.mapInArrow(_level_sums(level, out.feature[:, :2 ** level], out.bin[:, :2 ** level], slots, subsets, bins, seed), _LEVEL)
        dealt = sums.repartition(min(growing, spark.sparkContext.defaultParallelism * 2), "tree").sortWithinPartitions("tree", "part")
        splits = dealt.mapInArrow(_level_splits([s.shape for s in subsets], bins, least, min_gain), _FOUND).collect()
        next_ = [np.empty(0, dtype=np.int64) for _ in range(trees)]
        for r in splits:
            next_[r["tree"]] = _split(out, r["tree"], active[r["tree"]], subsets[r["tree"]], level + 1 == depth, r)
        active = next_
    return out


def _split(out: Trees, tree: int, nodes: np.ndarray, subset: np.ndarray, last: bool, r) -> np.ndarray:
    """Enters the splits that were found for the active ``nodes`` of a tree; its active nodes of the next level."""
    feature, at = (np.frombuffer(r[c], dtype=np.int64) for c in ("feature", "bin"))
    gain, total, left = (np.frombuffer(r[c], dtype=np.float64) for c in ("gain", "total", "left_"))
    total, left = total.reshape(-1, 3), left.reshape(-1, 3)
    root = nodes == 1
    out.stats[tree, nodes[root]] = total[root]
    out.impurity[tree, nodes[root]] = _variance(*total[root].T)
    out.valid[tree, nodes] = np.isfinite(gain)
    some = gain > 0
    inner = nodes[some]
    out.feature[tree, inner] = subset[np.flatnonzero(some), feature[some]]
    out.bin[tree, inner] = at[some]
    out.gain[tree, inner] = gain[some]
    children = []
    for child, stats in ((2 * inner, left[some]), (2 * inner + 1, total[some] - left[some])):
        out.stats[tree, child] = stats
        out.impurity[tree, child] = _variance(*stats.T)
        children.append(child[np.abs(out.impurity[tree, child]) >= EPSILON])
    return np.empty(0, dtype=np.int64) if last else np.sort(np.concatenate(children))


# ---------------------------------------------------------------- model

def _nodes(trees: Trees, tree: int, cuts: list[np.ndarray]) -> list[tuple]:
    """The nodes of a tree in the order in which Spark stores them (depth first), leaves of one prediction merged."""
    out: list[tuple] = []

    merged: dict[int, float] = {}

    def predicted(i: int) -> float:
        n, s, _ = trees.stats[tree, i]
        return merged.get(i, float(s / n) if n else 0.0)

    def pruned(i: int) -> bool:
        """Whether the tree below node i predicts one value."""
        if trees.feature[tree, i] < 0:
            return True
        ends = [pruned(2 * i), pruned(2 * i + 1)]
        if all(ends) and predicted(2 * i) == predicted(2 * i + 1):
            trees.feature[tree, i] = -1
            merged[i] = predicted(2 * i)
            return True
        return False

    pruned(1)

    def put(i: int) -> int:
        at = len(out)
        n, stats = trees.stats[tree, i, 0], [float(v) for v in trees.stats[tree, i]]
        impurity = float(trees.impurity[tree, i]) if trees.valid[tree, i] else -1.0
        out.append(())
        if trees.feature[tree, i] < 0:
            row = (at, predicted(i), impurity, stats, int(n), -1.0, -1, -1, (-1, [], -1))
        else:
            f, left = int(trees.feature[tree, i]), put(2 * i)
            right = put(2 * i + 1)
            row = (at, predicted(i), impurity, stats, int(n), float(trees.gain[tree, i]), left, right,
                   (f, [float(cuts[f][trees.bin[tree, i]])], -1))
        out[at] = row
        return at

    put(1)
    return out


def _model(est: Forest, dataset: DataFrame, trees: Trees, cuts: list[np.ndarray]) -> RandomForestRegressionModel:
    """A Spark model of these trees: a model of as many trees of one row is stored and read with their nodes in its place."""
    spark = dataset.sparkSession
    blank = spark.createDataFrame([(0.0, Vectors.dense([0.0] * len(cuts)))] * 2, [est.getLabelCol(), est.getFeaturesCol()])
    frame, path = est.by_spark(blank), stored_path(spark, "forest")
    frame.write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    names = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"]
    if schema["nodeData"].dataType.fieldNames() != names:
        raise RuntimeError(f"this Spark stores other nodes: {schema.simpleString()}")
    nodes = [(t, *node) for t in range(len(trees.feature)) for node in _nodes(trees, t, cuts)]
    tree, *columns, splits = zip(*nodes)
    split_type = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    split = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*splits), split_type)], fields=list(split_type))
    types = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    data = pa.StructArray.from_arrays([*[pa.array(c, k) for c, k in zip(columns, types)], split], names=names)
    table = pa.table({"treeID": pa.array(tree, pa.int32()), "nodeData": data})
    spark.createDataFrame(table, schema).write.mode("overwrite").parquet(f"{path}/data")
    return est._copyValues(RandomForestRegressionModel.load(path)._resetUid(est.uid))


def fit_forest(est: Forest, dataset: DataFrame, rows: int | None = None) -> RandomForestRegressionModel:
    """``est`` fitted on all rows of ``dataset``, of which there are ``rows``."""
    rows = dataset.count() if rows is None else rows
    features, label, seed = est.getFeaturesCol(), est.getLabelCol(), est.getSeed()
    bins = min(est.getMaxBins(), rows)
    share = max(bins * bins, 10_000) / rows  # as many as Spark takes to place the thresholds
    values = dataset.select(vector_to_array(F.col(features)).alias("x"))
    sample = np.array([r["x"] for r in (values.sample(False, share, seed) if share < 1 else values).collect()])
    cuts = [thresholds(sample[:, i], bins) for i in range(sample.shape[1])]
    # as few parts as there are cores, since each sends the sums of all nodes, and none of more than a block
    parts = max(dataset.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS))
    binned = stored(_binned(dataset, features, label, cuts).repartition(parts), "binned")
    looked_at = subset_size(est.getFeatureSubsetStrategy(), len(cuts), est.getNumTrees())
    trees = grow(binned, len(cuts), bins, est.getNumTrees(), est.getMaxDepth(), looked_at, est.getMinInstancesPerNode(), est.getMinInfoGain(), seed)
    return _model(est, dataset, trees, cuts)

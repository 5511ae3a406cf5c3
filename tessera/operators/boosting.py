"""Second-order gradient boosting for two classes, many models (settings x folds) at a time.

Features become quantile bins once. A tree grows level by level: gradient, Hessian and row counts are summed by (model, node,
feature, bin), the best split of every node follows from these sums, and a leaf's value is ``-G / (H + l2)``. Two kinds of
gain are offered: ``newton`` scores both sides by ``G² / (H + l2)`` with soft-thresholded ``G`` (l1), ``gamma`` per split and a least
Hessian weight per child; otherwise a split is scored by the variance of the gradients, and leaves take a Newton step.

* Up to ``LOCAL_ROWS`` training rows every model is grown by one task that holds their bins, all models in one job. Beyond that the
  blocks stay spread: all models grow in step, one aggregate a level (map-side combined, splits chosen on the executors), and only chosen
  splits reach the driver. Both ways give the same trees.
* In a task of its own a boosted model joins features to bundles of at most ``CELLS`` cells: one pass sums a bundle's cells, whose margins
  are its features' sums. Of two children the smaller one is summed, the other is the rest of their parent. Only the kinds of sums
  that its gain and limits read are made; values follow from the rows of the leaves.
* Elsewhere sums are made of the features that a node may split on only, and of the rows that still stand in an open node; a tree's rows keep
  their place from level to level. ``NODES`` nodes are summed and split at once, so that deep levels take no more memory than shallow ones.
* A forest is the same engine without margins: independent trees on Poisson bootstrap weights, splits by weighted Gini.
* Row and column samples come from hashes of (row, tree) and from seeds of (tree, node), so both ways, reruns and any partitioning agree.
* Margins are kept with the blocks, brought up to date once a tree, and written to the checkpoint folder every ``CUT_ROUNDS`` trees.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kmeans import uniform
from tessera.session import checkpoint_dir

BINS = 64
FOREST_TREES = 32       # trees of a forest that one task grows
LOCAL_ROWS = 2_000_000  # for 40 features 80 MB of bins, and as much again and a half for places, margins and gradients
BLOCK = 16_384
PACK_ROWS = 65_536      # rows that a task packs
CELLS = 1024            # cells of a bundle of features
CHUNK = 16_384          # rows summed at once, so that what is made of them stays in the processor's cache
BUNDLE_DEPTH = 10       # deeper boosted trees sum the columns of a node alone
NODES = 512             # nodes summed at once
CUT_ROUNDS = 8


@dataclass(frozen=True)
class Boost:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    newton: bool = True
    l2: float = 1.0
    l1: float = 0.0
    gamma: float = 0.0
    min_child: float = 1.0      # Hessian weight of a child (newton)
    min_leaf: int = 1           # rows of a child
    min_split: int = 2          # rows of a node that is split
    subsample: float = 1.0      # rows of a tree
    columns_tree: float = 1.0   # features of a tree
    columns_node: str = "all"   # features of a node: all or sqrt
    seed: int = 42
    forest: bool = False        # independent trees on bootstrap weights and balanced classes; leaves hold the share of class 1
    first: int = 0              # number of the first tree, for seeds


SIDE = 2.0 ** 26         # a forest's weights of class 0 stand above those of class 1

#: Distribution of a bootstrap weight (Poisson with mean 1).
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(12), 1)))


@dataclass
class Tree:
    """Nodes in order of creation; node i goes left (to ``left[i]``) where the bin is at most ``cut[i]``, else to the next one."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    open: list = field(default_factory=lambda: [0])         # nodes of the level that grows

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node in which every row of ``codes`` ends so far."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = left[at] + (codes[rows, feature[at]] > cut[at])
        return node

    def apply(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]

    def grow(self, splits: dict) -> None:
        """Take the best split of every open node; ``splits``: node -> (feature, cut, gain, value, left value, right value)."""
        after = []
        for node in self.open:
            if node not in splits:
                continue
            feature, cut, gain, value, low, high = splits[node]
            self.value[node] = value
            if feature >= 0:
                self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
                after += [len(self.feature), len(self.feature) + 1]
                for x, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.gain, 0.0)):
                    x += [v, v]
                self.value += [low, high]
        self.open = after

    def close(self) -> "Tree":
        """No node is open any more; the lists become arrays, which are many times smaller."""
        self.open = []
        self.feature, self.cut, self.left = array("h", self.feature), array("h", self.cut), array("i", self.left)
        self.value, self.gain = array("d", self.value), array("d", self.gain)
        return self


def columns(nodes: list, tree_no: int, st: Boost, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, w): the features whose sums a node needs, in ascending order, and whether it may split on them."""
    tree_no += st.first
    of_tree = np.ones(n_features, bool)
    if st.columns_tree < 1:
        keep = max(1, round(st.columns_tree * n_features))
        of_tree = np.isin(np.arange(n_features), np.random.default_rng([st.seed, tree_no]).permutation(n_features)[:keep])
    if st.columns_node == "sqrt":
        few = max(1, int(np.sqrt(n_features)))
        draw = uniform((np.array(nodes)[:, None] * n_features + np.arange(n_features)).ravel(), st.seed * 7_000_003 + tree_no)
        cols = np.sort(np.argsort(draw.reshape(len(nodes), n_features), axis=1, kind="stable")[:, :few], axis=1)
    else:
        cols = np.tile(np.flatnonzero(of_tree), (len(nodes), 1))
    return cols, of_tree[cols]


def best_splits(sums: np.ndarray, nodes: list, tree_no: int, st: Boost, n_features: int) -> dict:
    """node -> split of each row of ``sums`` (nodes, its ``columns``, bins, 3: gradient, Hessian, rows)."""
    cols, allowed = columns(nodes, tree_no, st, n_features)
    total = sums[:, 0].sum(axis=1)[:, None, None, :]
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total - left

    def pull(g):
        return np.sign(g) * np.maximum(np.abs(g) - st.l1, 0)

    def score(x):
        g, h, n = x[..., 0], x[..., 1], x[..., 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            s = pull(g) ** 2 / (h + st.l2) if st.newton else g * g / n
        return np.where(n > 0, s, 0.0)

    def value(x):
        return leaf_values(x[:, 0], x[:, 1], st).tolist()

    gain = score(left) + score(right) - score(total)
    gain = gain / 2 - st.gamma if st.newton else gain
    fits = (left[..., 2] >= st.min_leaf) & (right[..., 2] >= st.min_leaf) & (total[..., 2] >= st.min_split) & allowed[:, :, None]
    if st.newton:
        fits &= (left[..., 1] >= st.min_child) & (right[..., 1] >= st.min_child)
    gain = np.where(fits & (gain > 1e-9), gain, -np.inf)
    here = value(total[:, 0, 0])
    if not gain[0].size:
        return {node: (-1, 0, 0.0, v, 0.0, 0.0) for node, v in zip(nodes, here)}
    # rounded, so that the order of a sum's parts decides no tie: the first of equals
    f, b = np.divmod(np.round(gain, 9).reshape(len(nodes), -1).argmax(axis=1), gain.shape[2])
    i = np.arange(len(nodes))
    best = gain[i, f, b].tolist()
    low, high = value(left[i, f, b]), value(right[i, f, b])
    return {node: (f_, b_, g, v, x, y) if g > -np.inf else (-1, 0, 0.0, v, 0.0, 0.0)
            for node, f_, b_, g, v, x, y in zip(nodes, cols[i, f].tolist(), b.tolist(), best, here, low, high)}


def leaf_values(g: np.ndarray, h: np.ndarray, st: Boost) -> np.ndarray:
    """Values of leaves with these sums."""
    top, below = (np.sign(g) * np.maximum(np.abs(g) - st.l1, 0), h + st.l2) if st.newton else (g, h)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(below) > 1e-150, -top / below, 0.0)


class Rows:
    """Rows of a block: ids, bins, labels, folds, and a margin for every model."""

    def __init__(self, ids, codes, y, fold, margins):
        self.ids, self.codes, self.y, self.fold, self.margins = ids, codes, y, fold, margins


class Descent:
    """The rows of model ``m``'s tree number ``no`` on their way down: place, bins, gradient and Hessian of those not yet in a leaf."""

    def __init__(self, block: Rows, m: int, st: Boost, fold: int | None, balance: tuple[float, float], no: int):
        """``balance``: the classes' weights."""
        self.st, self.no, salt = st, no, st.seed * 1_000_003 + no + st.first
        use = np.ones(len(block.y), bool) if fold is None else block.fold != fold
        if st.subsample < 1:
            use &= uniform(block.ids, salt) <= st.subsample
        if st.forest:
            times = np.searchsorted(_POISSON, uniform(block.ids, salt))
            use &= times > 0
        rows = np.flatnonzero(use)
        y = block.y[rows]
        if st.forest:       # G² / H of these is the weighted variance that a Gini split lowers, -G / H the share of class 1
            self.h = times[rows] * np.where(y > 0, balance[1], balance[0])
            self.g = -self.h * y
        else:
            p = 1 / (1 + np.exp(-block.margins[m][rows]))
            self.g, self.h = p - y, p * (1 - p)
        self.codes, self.node = block.codes[rows], np.zeros(len(rows), np.int64)

    def follow(self, tree: Tree) -> None:
        """Down to the open nodes; rows that end in a leaf before leave."""
        feature, cut, left = np.array(tree.feature), np.array(tree.cut), np.array(tree.left)
        while len(self.node) and self.node[0] < tree.open[0]:       # all rows stand at one depth, open nodes come last
            f = feature[self.node]
            inner = f >= 0
            if not inner.all():
                self.codes, self.node, self.g, self.h, f = (x[inner] for x in (self.codes, self.node, self.g, self.h, f))
            over = self.codes[np.arange(len(f)), f] > cut[self.node]
            self.node = left[self.node] + over

    def sums(self, tree: Tree, bins: int):
        """(nodes, (nodes, their ``columns``, bins, 3)) of the open nodes, ``NODES`` at a time."""
        place = self.node - tree.open[0]
        for at in range(0, len(tree.open), NODES):
            nodes = tree.open[at:at + NODES]
            if len(tree.open) > NODES:
                rows = np.flatnonzero((place >= at) & (place < at + NODES))
                node, codes, g, h = place[rows] - at, self.codes[rows], self.g[rows], self.h[rows]
            else:
                node, codes, g, h = place, self.codes, self.g, self.h
            cols, _ = columns(nodes, self.no, self.st, codes.shape[1])
            every, start, size = np.arange(len(node)), node * bins, len(nodes) * bins
            out = np.empty((len(nodes), cols.shape[1], bins, 3))
            for k in range(cols.shape[1]):
                code = codes[every, cols[node, k]] if self.st.columns_node == "sqrt" else codes[:, cols[0, k]]
                cell = start + code
                for c, v in enumerate((g, h, None)):
                    out[:, k, :, c] = np.bincount(cell, v, size).reshape(len(nodes), bins)
            yield nodes, out


class Grove:
    """Trees as they came from the tasks, compressed: one piece at a time stands unpacked."""

    def __init__(self, pieces=()):
        self.pieces = list(pieces)      # (number of trees, bytes)

    def __len__(self):
        return sum(n for n, _ in self.pieces)

    def __iter__(self):
        for _, raw in self.pieces:
            yield from pickle.loads(zlib.decompress(raw))


@dataclass
class Model:
    """A model in the making, and afterwards the fitted one."""

    st: Boost
    fold: int | None            # rows of this fold are left out
    base: float
    cols: list = field(default_factory=list)
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    balance: tuple = (1.0, 1.0)

    def chance(self, codes: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.st.forest:
            return sum((t.apply(codes) for t in self.trees), np.zeros(len(codes))) / max(1, len(self.trees))
        return 1 / (1 + np.exp(-self.margin(codes)))

    def margin(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for t in self.trees:
            out += self.st.rate * t.apply(codes)
        return out

    def importances(self) -> list[float]:
        """Share of the total gain by feature."""
        total = np.zeros(len(self.cols))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
        return (total / (total.sum() or 1.0)).tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a probability vector, as fitted classifiers of ``pyspark.ml`` give it."""
        shared = df.sparkSession.sparkContext.broadcast(self)       # bounded by rounds x 2^depth nodes

        @F.pandas_udf("double")
        def chance(x):
            import pandas as pd
            model = shared.value
            codes = bin_codes(np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1), model.edges)
            return pd.Series(model.chance(codes))

        p = chance(F.array(*[F.col(c).cast("double") for c in self.cols]))
        return df.withColumn("_chance", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_chance"), F.col("_chance")))).drop("_chance")


def bin_codes(x: np.ndarray, edges: list) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def quantile_edges(df: DataFrame, cols: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cuts between the bins of every feature, by one aggregate."""
    at = [F.lit(i / bins) for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*at), F.lit(10_000)).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    return [np.unique(np.array(row[i] or [], dtype=np.float64)) for i in range(len(cols))]


def _packed(df: DataFrame, cols, edges, key, label, fold, block: int) -> DataFrame:
    """(first, ids, codes, y, fold) of consecutive rows as binary blocks, ``first`` their least id."""
    width = len(cols)

    def pack(batches):
        import pyarrow as pa
        held, n = [], 0

        def out():
            ids, y, f, codes = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([int(ids.min())], pa.int64()), *[pa.array([v[order].tobytes()], pa.binary()) for v in (ids, codes, y, f)]],
                                              ["first", "ids", "codes", "y", "fold"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            held.append([batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1).to_numpy(zero_copy_only=False).astype("<f8"),
                         batch.column(2).to_numpy(zero_copy_only=False).astype("<i4"), bin_codes(x, edges)])
            n += batch.num_rows
            if n >= block:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    rows = df.select(F.col(key).cast("long"), F.col(label).cast("double"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("_f"),
                     F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    return rows.mapInArrow(pack, "first long, ids binary, codes binary, y binary, fold binary")


def _rows(record, width: int, margins) -> Rows:
    ids, codes, y, fold = record
    ids = np.frombuffer(ids, "<i8")
    return Rows(ids, np.frombuffer(codes, np.uint8).reshape(len(ids), width), np.frombuffer(y, "<f8"), np.frombuffer(fold, "<i4"), margins(len(ids)))


class Bundles:
    """Bins of several features as one number of fewer than ``CELLS`` values."""

    def __init__(self, sizes):
        """``sizes``: bins of every feature."""
        self.sizes, self.members, self.cells = [int(x) for x in sizes], [], []
        for f in sorted(range(len(self.sizes)), key=lambda f: (-self.sizes[f], f)):
            fits = [b for b, n in enumerate(self.cells) if n * self.sizes[f] <= CELLS]
            if fits:
                self.members[fits[0]].append(f)
                self.cells[fits[0]] *= self.sizes[f]
            else:
                self.members.append([f])
                self.cells.append(self.sizes[f])
        self.of = np.zeros(len(self.sizes), np.int64)       # a feature's bundle, and its step there
        self.step = np.ones(len(self.sizes), np.int64)
        for b, members in enumerate(self.members):
            for i, f in enumerate(members):
                self.of[f], self.step[f] = b, int(np.prod([self.sizes[x] for x in members[i + 1:]]))

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """(bundles, rows)."""
        out = np.zeros((len(self.members), len(codes)), np.uint16)
        for f in range(len(self.sizes)):
            out[self.of[f]] += codes[:, f] * np.uint16(self.step[f])
        return out

    def right(self, feature: int, cut: int) -> np.ndarray:
        """Whether a row goes right, for every cell of the feature's bundle."""
        return np.arange(CELLS) // self.step[feature] % self.sizes[feature] > cut

    def sums(self, packed: np.ndarray, pieces, n: int, bins: int, kinds) -> np.ndarray:
        """(n, features, bins, 3) over ``pieces``: (rows, their places or None for 0). ``kinds``: gradient, Hessian and count of
        every row, 1 for plain counts, None for a sum that is not read."""
        found = [[None if v is None else np.zeros(n * cells) for v in kinds] for cells in self.cells]
        for rows, place in pieces:
            values = [v if v is None or isinstance(v, int) else v[rows] for v in kinds]
            for b, cells in enumerate(self.cells):
                cell = packed[b, rows].astype(np.int64) if place is None else place * cells + packed[b].take(rows)
                for c, v in enumerate(values):
                    if v is not None:
                        found[b][c] += np.bincount(cell, None if isinstance(v, int) else v, n * cells)
        out = np.zeros((n, len(self.sizes), bins, 3))
        for members, of_bundle in zip(self.members, found):
            for c, v in enumerate(of_bundle):
                if v is None:
                    continue
                v = v.reshape(n, *[self.sizes[f] for f in members])
                for i, f in enumerate(members):
                    out[:, f, :self.sizes[f], c] = v.sum(axis=tuple(j + 1 for j in range(len(members)) if j != i))
        return out


def _grow_boosted(packed: np.ndarray, bundles: Bundles, ids, y, margin, model: Model, bins: int) -> None:
    """All trees of a boosted model over all its rows; ``margin`` is brought up to date."""
    st, width, n = model.st, len(bundles.sizes), len(y)
    # with a least Hessian weight above 0 no child is empty
    counted = not st.newton or st.min_leaf > 1 or st.min_split > 2 or st.min_child <= 0
    every = st.columns_node != "sqrt" and st.columns_tree >= 1
    flat, g, h, use = packed.reshape(-1), np.empty(n), np.empty(n), np.ones(n, bool)
    chunks = [(at, min(at + CHUNK, n)) for at in range(0, n, CHUNK)]

    def step(tree, node):
        """Rows of split nodes go on to the next ones; rows by node."""
        inner = [x for x, f in enumerate(tree.feature) if f >= 0]
        to, spot, turn = np.arange(len(tree.feature)), np.zeros(len(tree.feature), np.int64), np.zeros((len(tree.feature), CELLS), np.uint8)
        for x in inner:
            to[x], spot[x], turn[x] = tree.left[x], bundles.of[tree.feature[x]] * n, bundles.right(tree.feature[x], tree.cut[x])
        turn, found = turn.reshape(-1), np.zeros(len(to), np.int64)
        for a, b in chunks:
            at = node[a:b]
            value = flat.take(spot.take(at) + np.arange(a, b))
            node[a:b] = to.take(at) + turn.take(at * CELLS + value)
            found += np.bincount(node[a:b], minlength=len(to))
        return found

    def light(node, place, size):
        """Pieces of the rows whose node has a place."""
        wide = max(CHUNK, 4 * size * CELLS)
        for a in range(0, n, wide):
            at = place.take(node[a:a + wide])
            rows = np.flatnonzero((at >= 0) & use[a:a + wide])
            yield rows + a, at[rows]

    for no in range(st.rounds):
        for a, b in chunks:
            p = 1 / (1 + np.exp(-margin[a:b]))
            if st.subsample < 1:
                use[a:b] = uniform(ids[a:b], st.seed * 1_000_003 + no + st.first) <= st.subsample
            g[a:b], h[a:b] = (p - y[a:b]) * use[a:b], p * (1 - p) * use[a:b]
        tree, node = Tree(), np.zeros(n, np.int64)
        sums = bundles.sums(packed, ((slice(a, b), None) for a, b in chunks), 1, bins,
                            (g, h if st.newton else None, use.astype(float) if counted else None))
        for depth in range(st.depth):
            if depth:
                rows_of = step(tree, node)
                pairs = len(tree.open) // 2
                small = rows_of[tree.open[0]:].reshape(pairs, 2).argmin(axis=1)      # open nodes come in pairs, and last
                place = np.full(len(tree.feature), -1)
                place[tree.open[0] + 2 * np.arange(pairs) + small] = np.arange(pairs)
                less = bundles.sums(packed, light(node, place, pairs), pairs, bins, (g, h if st.newton else None, 1 if counted else None))
                whole = sums[[i for i, x in enumerate(before) if tree.feature[x] >= 0]]
                sums = np.empty((pairs, 2, *less.shape[1:]))
                sums[np.arange(pairs), small], sums[np.arange(pairs), 1 - small] = less, whole - less
                sums = sums.reshape(2 * pairs, *less.shape[1:])
            if not counted:
                sums[..., 2] = 1
            before = tree.open
            mine = sums if every else sums[np.arange(len(before))[:, None], columns(before, no, st, width)[0]]
            tree.grow(best_splits(mine, before, no, st, width))
            if not tree.open:
                break
        else:
            step(tree, node)        # the last level's rows, on to their leaves
        total = [np.bincount(node, v, len(tree.feature)) for v in (g, h)]
        for x in range(len(tree.feature) - 1, -1, -1):
            if tree.feature[x] >= 0:
                for v in total:
                    v[x] = v[tree.left[x]] + v[tree.left[x] + 1]
        tree.value = leaf_values(*total, st).tolist()
        move = st.rate * np.array(tree.value)
        for a, b in chunks:
            margin[a:b] += move.take(node[a:b])
        model.trees.append(tree.close())


def _grow_forest(codes: np.ndarray, ids, y, model: Model, bins: int) -> None:
    """All trees of a forest over all its rows. A row's bootstrap weight is packed with its class into one number, whose sums
    are exact: ``SIDE`` times the weight of class 0, plus that of class 1."""
    st, width, flat = model.st, codes.shape[1], codes.reshape(-1)
    counted = st.min_leaf > 1 or st.min_split > 2           # else a weight above 0 says as much
    for no in range(st.rounds):
        times = np.concatenate([np.searchsorted(_POISSON, uniform(ids[a:a + CHUNK], st.seed * 1_000_003 + no + st.first))
                                for a in range(0, len(ids), CHUNK)] or [np.zeros(0, np.int64)])
        rows = np.flatnonzero(times)
        w = times[rows] * np.where(y[rows] > 0, 1.0, SIDE)
        at, node, tree = rows * width, np.zeros(len(rows), np.int64), Tree()
        del times, rows
        for depth in range(st.depth):
            if depth:
                feature, cut, to = np.array(tree.feature), np.array(tree.cut), np.array(tree.left)
                leaf = feature < 0
                feature[leaf], cut[leaf], to[leaf] = 0, bins, np.flatnonzero(leaf)
                for a in range(0, len(node), CHUNK):
                    here = node[a:a + CHUNK]
                    node[a:a + CHUNK] = to.take(here) + (flat.take(at[a:a + CHUNK] + feature.take(here)) > cut.take(here))
                stays = np.flatnonzero(node >= tree.open[0])
                if len(stays) < 0.9 * len(node):
                    at, w, node = at[stays], w[stays], node[stays]
            splits: dict = {}
            for first in range(0, len(tree.open), NODES):
                nodes = tree.open[first:first + NODES]
                mine = np.flatnonzero((node >= nodes[0]) & (node <= nodes[-1])) if depth else np.arange(len(node))
                cols, _ = columns(nodes, no, st, width)
                k, size = cols.shape[1], len(nodes) * bins
                both, count = np.zeros(k * size), np.zeros(k * size)
                shift = np.arange(k)[:, None] * size
                of = np.ascontiguousarray(cols.T)
                for a in range(0, len(mine), CHUNK):
                    r = mine[a:a + CHUNK]
                    here = node.take(r) - nodes[0]
                    cell = ((here * bins + shift) + flat.take(of.take(here, axis=1) + at.take(r))).reshape(-1)
                    both += np.bincount(cell, np.tile(w.take(r), k), k * size)
                    if counted:
                        count += np.bincount(cell, None, k * size)
                zero = np.floor(both / SIDE)
                one = both - zero * SIDE
                sums = np.stack([-model.balance[1] * one, model.balance[1] * one + model.balance[0] * zero, count if counted else zero + one], axis=1)
                sums = np.ascontiguousarray(sums.reshape(k, len(nodes), bins, 3).transpose(1, 0, 2, 3))
                splits |= best_splits(sums, nodes, no, st, width)
            tree.grow(splits)
            if not tree.open:
                break
        model.trees.append(tree.close())


def _grow_alone(rows: Rows, model: Model, bins: int) -> None:
    """All trees of one model over one block that holds all rows."""
    width, st = rows.codes.shape[1], model.st
    if st.forest or st.depth <= BUNDLE_DEPTH:
        keep = slice(None) if model.fold is None else np.flatnonzero(rows.fold != model.fold)
        if st.forest:
            return _grow_forest(np.ascontiguousarray(rows.codes[keep]), rows.ids[keep], rows.y[keep], model, bins)
        margin, bundles = rows.margins[0][keep], Bundles(rows.codes.max(axis=0, initial=0).astype(int) + 1)
        _grow_boosted(bundles.pack(rows.codes[keep]), bundles, rows.ids[keep], rows.y[keep], margin, model, bins)
        rows.margins[0][keep] = margin
        return None
    for no in range(st.rounds):
        tree, down = Tree(), Descent(rows, 0, st, model.fold, model.balance, no)
        for _ in range(st.depth):
            down.follow(tree)
            splits: dict = {}
            for nodes, sums in down.sums(tree, bins):
                splits |= best_splits(sums, nodes, no, st, width)
            tree.grow(splits)
            if not tree.open:
                break
        model.trees.append(tree.close())
        rows.margins[0] += st.rate * tree.apply(rows.codes)


def _one_task_each(blocks: DataFrame, models: list[Model], width: int, bins: int) -> None:
    spark = blocks.sparkSession
    # longest first, one partition each: the join's hash sends each of these numbers to a partition of its own
    order = sorted(range(len(models)), key=lambda m: -models[m].st.rounds * (1 if models[m].st.forest else models[m].st.depth))
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(len(models)))
    free = [r["g"] for r in spark.range(64 * len(models)).groupBy(at.alias("at")).agg(F.min("id").cast("int").alias("g")).orderBy("at").collect()]
    task = {m: free[i % len(free)] for i, m in enumerate(order)}

    def grown(m, parts):
        """The model's trees; the parts are emptied as the rows are put together."""
        import pyarrow as pa
        model = models[m]
        bundles = Bundles([len(e) + 1 for e in model.edges])
        boosted = not model.st.forest and model.st.depth <= BUNDLE_DEPTH
        n = sum(len(x[0]) for x in parts)
        ids, y = np.empty(n, "<i8"), np.empty(n, "<f8")
        codes = np.empty((len(bundles.members), n), np.uint16) if boosted else np.empty((n, width), np.uint8)
        to = n
        while parts:
            i, c, v = parts.pop()
            to -= len(i)
            ids[to:to + len(i)], y[to:to + len(i)] = i, v
            if boosted:
                codes[:, to:to + len(i)] = bundles.pack(c)
            else:
                codes[to:to + len(i)] = c
            del i, c, v
        pa.default_memory_pool().release_unused()
        if boosted:
            _grow_boosted(codes, bundles, ids, y, np.full(n, model.base), model, bins)
        else:
            _grow_alone(Rows(ids, codes, y, np.full(n, -1, "<i4"), [np.full(n, model.base)]), model, bins)
        return pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([zlib.compress(pickle.dumps(model.trees), 1)], pa.binary())], ["m", "trees"])

    def train(batches):
        now, parts = None, []
        for batch in batches:
            for j in range(batch.num_rows):
                m = batch.column(0)[j].as_py()
                if m != now and parts:
                    yield grown(now, parts)
                now = m
                # views of the batch, no copies
                ids, codes, y, fold = (np.frombuffer(batch.column(c)[j].as_buffer(), kind) for c, kind in ((1, "<i8"), (2, np.uint8), (3, "<f8"), (4, "<i4")))
                codes = codes.reshape(len(ids), width)
                if models[m].fold is not None:
                    keep = np.flatnonzero(fold != models[m].fold)
                    ids, codes, y = ids[keep], codes[keep], y[keep]
                parts.append((ids, codes, y))
            del batch
        if parts:
            yield grown(now, parts)

    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(g).alias("g")) for m, g in task.items()])).alias("_t")
    each = blocks.select("first", "ids", "codes", "y", "fold", pairs).select("_t.g", "_t.m", "first", "ids", "codes", "y", "fold")
    each = each.repartition(len(models), "g").sortWithinPartitions("m", "first").select("m", "ids", "codes", "y", "fold")
    for r in each.mapInArrow(train, "m int, trees binary").collect():        # the models' parameters
        models[r["m"]].trees = Grove([(models[r["m"]].st.rounds, bytes(r["trees"]))])


def _in_step(blocks: DataFrame, models: list[Model], width: int, bins: int) -> None:
    """All models level by level over spread blocks: one aggregate a level."""
    checkpoint_dir(blocks.sparkSession)  # the cluster's shared folder (set locally only when unset)
    state, since = blocks.drop("first").withColumn("margins", F.lit(None).cast("binary")), 0
    kept: list[DataFrame] = []                              # margins since the last cut
    settings, folds, bases, balances = [m.st for m in models], [m.fold for m in models], [[m.base] for m in models], [m.balance for m in models]

    def current(record, margins, new):
        """Rows with margins up to the last whole tree; ``new`` has the trees since they were written."""
        rows = _rows(record, width, lambda n: np.repeat(bases, n, axis=1) if margins is None
                     else np.frombuffer(margins, "<f8").reshape(len(bases), n).copy())
        for i, trees in enumerate(new):
            for t in trees if not settings[i].forest else ():
                rows.margins[i] += settings[i].rate * t.apply(rows.codes)
        return rows

    def level(growing, new, no):
        def run(batches):
            import pyarrow as pa
            total = {}
            for batch in batches:
                for *record, margins in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = current(record, margins, new)
                    for i, tree in growing.items():
                        down = Descent(rows, i, settings[i], folds[i], balances[i], no)
                        down.follow(tree)
                        for nodes, found in down.sums(tree, bins):
                            total[i, nodes[0]] = total[i, nodes[0]] + found if (i, nodes[0]) in total else found
            for (i, first), sums in total.items():
                node, feature, bin_ = np.nonzero(sums[..., 2])          # feature: its place among the node's columns
                v = sums[node, feature, bin_]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), i, np.int32)), pa.array((first + node).astype(np.int32)),
                                                  pa.array(feature.astype(np.int32)), pa.array(bin_.astype(np.int32)),
                                                  *[pa.array(v[:, c]) for c in range(3)]], ["m", "node", "feature", "bin", "g", "h", "n"])
        return run

    def choose(no):
        def run(key, pdf):
            import pandas as pd
            m, node = int(key[0]), int(key[1])
            sums = np.zeros((1, columns([node], no, settings[m], width)[0].shape[1], bins, 3))
            sums[0, pdf["feature"], pdf["bin"]] = pdf[["g", "h", "n"]].to_numpy()
            return pd.DataFrame([(m, node, *best_splits(sums, [node], no, settings[m], width)[node])],
                                columns=["m", "node", "feature", "cut", "gain", "value", "low", "high"])
        return run

    for no in range(max(m.st.rounds for m in models)):
        new = [m.trees[since:] for m in models]
        making = {i: Tree() for i, m in enumerate(models) if m.st.rounds > no}
        growing, depth = dict(making), 0
        while growing:
            sums = state.mapInArrow(level(growing, new, no), "m int, node int, feature int, bin int, g double, h double, n double") \
                .groupBy("m", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
            found = sums.groupBy("m", "node").applyInPandas(choose(no), "m int, node int, feature int, cut int, gain double, value double, low double, high double")
            splits: dict = {}
            for r in found.collect():                                        # a row per open node
                splits.setdefault(r["m"], {})[r["node"]] = tuple(r)[2:]
            depth += 1
            for i, tree in growing.items():
                tree.grow(splits.get(i, {}))
            growing = {i: t for i, t in growing.items() if t.open and depth < models[i].st.depth}
        for i, tree in making.items():
            models[i].trees.append(tree.close())
        if not all(st.forest for st in settings):
            def put(batches, new=[m.trees[since:] for m in models]):
                import pyarrow as pa
                for batch in batches:
                    for *record, margins in zip(*(c.to_pylist() for c in batch.columns)):
                        raw = current(record, margins, new).margins.astype("<f8").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*record, raw)], ["ids", "codes", "y", "fold", "margins"])
            after = state.mapInArrow(put, state.schema)
            if (no + 1) % CUT_ROUNDS == 0:
                state = after.checkpoint(eager=True)
                for x in kept:
                    x.unpersist()
                kept = []
            else:
                state = after.persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(state)
            since = no + 1
    for x in kept:
        x.unpersist()


def fit_many(df: DataFrame, cols: list[str], specs: list[tuple[Boost, int | None]], key: str, label: str, fold: str | None = None,
             bins: int = BINS) -> list[Model]:
    """A model per (settings, left-out fold) of ``specs``; ``fold`` names the column of fold numbers. Forests are grown in parts of
    ``FOREST_TREES`` trees."""
    edges = quantile_edges(df, cols, bins)
    sizes = {r["f"]: (r["n"], r["p"]) for r in df.groupBy((F.col(fold) if fold else F.lit(-1)).alias("f"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).collect()}      # a row per fold
    n_rows = sum(n for n, _ in sizes.values())
    models = []
    for st, out in specs:
        n, p = (sum(v[i] for f, v in sizes.items() if out is None or f != out) for i in (0, 1))
        share = min(max(p / n, 1e-6), 1 - 1e-6) if n else 0.5
        balance = (0.5 / (1 - share), 0.5 / share) if st.forest else (1.0, 1.0)
        models.append(Model(st, out, float(np.log(share / (1 - share))), list(cols), edges, [], balance))
    if not n_rows:
        return models
    pieces = [(m, replace(m, trees=[], st=replace(m.st, first=at, rounds=min(FOREST_TREES, m.st.rounds - at)) if m.st.forest else m.st))
              for m in models for at in (range(0, m.st.rounds, FOREST_TREES) if m.st.forest else (0,))]
    alone, bins = n_rows <= LOCAL_ROWS, max(len(e) for e in edges) + 1
    # blocks of neighbouring ids: put together by their first ids they are in one order, however they were spread
    source = df.repartitionByRange(max(1, -(-n_rows // PACK_ROWS)), key).sortWithinPartitions(key) if alone else df
    blocks = _packed(source, cols, edges, key, label, fold, BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    width = len(cols)
    (_one_task_each if alone else _in_step)(blocks, [piece for _, piece in pieces], width, bins)
    for m, piece in pieces:
        m.trees = Grove([*m.trees.pieces, *piece.trees.pieces] if m.trees else piece.trees.pieces) if alone else [*m.trees, *piece.trees]
    blocks.unpersist()
    return models

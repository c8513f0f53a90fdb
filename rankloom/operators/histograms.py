"""Second-order trees, grown leaf by leaf on features that were binned once.

Bins come from mergeable quantile sketches (Spark's ``percentile_approx``). A pass over
the binned rows sums gradient, curvature and rows per (leaf, feature, bin); it reads only the
smaller child of each new pair, the other one is the parent less its sibling. The best
leaf is split until the tree has its leaves. A pass looks at all leaves that may be split next, so
a tree takes about as many passes as it has levels, not as many as it has leaves.

Sums of few cells (``DRIVER_CELLS``) are taken in arrays by each task and searched on the driver,
more of them are summed and searched in Spark by windows over the bins; both find the same splits. Gains that differ by less than ``1e-9`` a row
are equal, and the first feature and bin decide, so trees do not depend on the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.trees import Node, as_matrix, leaf_values, tree_column

#: Cells (leaf, feature, bin) of a tree that the driver may hold: 24 bytes each.
DRIVER_CELLS = 2_000_000
#: Gains are compared in steps of this much per training row.
GAIN_STEP = 1e-9
#: The sketches' rank error is a bin's share over this.
SKETCH_STEPS = 20

Sums = tuple[float, float, int]


# -- bins --------------------------------------------------------------------------

@dataclass(frozen=True)
class Binning:
    """Edges of each feature: a value's bin is the number of edges below it. Category numbers are bins."""

    edges: tuple[tuple[float, ...], ...]
    categories: Mapping[int, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: DataFrame, max_bins: int, categorical: Iterable[int] = (), n_features: int = 0) -> Binning:
        """Quantiles of ``features`` by one sketch a feature; ranks are off by a twentieth of a bin at most.

        Missing values (NULL, NaN) have no part in the edges.
        """
        values = rows.select(F.posexplode("features").alias("feature", "value")).where(
            F.col("value").isNotNull() & ~F.isnan("value"))
        steps = [i / max_bins for i in range(1, max_bins)] or [0.5]
        sketches = values.groupBy("feature").agg(
            F.percentile_approx("value", steps, SKETCH_STEPS * max_bins).alias("edges"), F.max("value").alias("top"))
        found = {row["feature"]: row for row in sketches.collect()}
        edges = tuple(
            tuple(sorted({x for x in found[i]["edges"] if x < found[i]["top"]})) if i in found else ()
            for i in range(n_features or max(found, default=-1) + 1))
        arity = {i: int(found[i]["top"]) + 1 if i in found else 0 for i in categorical}
        return cls(edges, arity)

    @property
    def cells(self) -> int:
        return len(self.edges) * self.width

    @property
    def width(self) -> int:
        """Bins of a feature, the one of missing values included."""
        return max([len(e) + 2 for e in self.edges] + [n + 1 for n in self.categories.values()], default=1)

    def assign(self, rows: DataFrame, out: str = "bins") -> DataFrame:
        """Add the bin numbers as one array; a missing value is in a bin of its own, behind all others."""
        cut = {i: e for i, e in enumerate(self.edges) if e and i not in self.categories}
        value = {i: F.coalesce(F.get("features", i), F.lit(math.nan)) for i in range(len(self.edges))}
        wide = rows.withColumns({f"_x{i}": value[i] for i in cut})
        if cut:
            # Bucketizer's ranges are closed below: an edge belongs to the bin that it ends.
            splits = [[-math.inf, *(math.nextafter(x, math.inf) for x in e), math.inf] for e in cut.values()]
            wide = Bucketizer(
                splitsArray=splits, inputCols=[f"_x{i}" for i in cut], outputCols=[f"_b{i}" for i in cut],
                handleInvalid="keep").transform(wide)
        bins = []
        for i in range(len(self.edges)):
            if i in cut:
                bins.append(F.col(f"_b{i}"))
            elif i in self.categories:
                known = (value[i] >= 0) & (value[i] < self.categories[i])
                bins.append(F.when(known, value[i]).otherwise(self.categories[i]))
            else:
                bins.append(F.when(F.isnan(value[i]), 1).otherwise(0))
        helpers = [f"_{kind}{i}" for i in cut for kind in "xb"]
        return wide.withColumn(out, F.array(*[b.cast("short") for b in bins]).cast("array<short>")).drop(*helpers)


# -- splits ------------------------------------------------------------------------

def newton_step(pull: float, curve: float, l1: float = 0.0, l2: float = 0.0) -> float:
    """The value of a leaf with these sums of gradient and curvature."""
    shrunk = math.copysign(max(abs(pull) - l1, 0.0), pull)
    return shrunk / (curve + l2) if curve + l2 > 0 else 0.0


@dataclass(frozen=True)
class Rules:
    """What a split must meet, and how long a tree grows."""

    num_leaves: int
    max_depth: int | None = None
    min_leaf_rows: int = 1
    min_leaf_hessian: float = 0.0
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0

    def may_split(self, sums: Sums, depth: int) -> bool:
        return sums[2] >= 2 * max(self.min_leaf_rows, 1) and (self.max_depth is None or depth < self.max_depth)


@dataclass(frozen=True)
class Split:
    """The rows of a leaf up to ``bin`` of a feature, or in ``categories``, go left."""

    gain: float
    steps: int
    feature: int
    bin: int
    categories: tuple[int, ...] | None
    left: Sums
    right: Sums


def _score(g, h, rules: Rules):
    """What a leaf with these sums gains over a value of 0, twice."""
    shrunk = np.maximum(np.abs(g) - rules.l1, 0.0)
    total = h + rules.l2
    return np.divide(shrunk * shrunk, total, out=np.zeros_like(shrunk), where=total > 0)


def best_split(cells: np.ndarray, rules: Rules, unit: float, categorical: Iterable[int] = ()) -> Split | None:
    """The best split of a leaf, from its sums (3, features, bins) of gradient, curvature and rows."""
    cells = cells.copy()
    order = np.broadcast_to(np.arange(cells.shape[2]), cells.shape[1:]).copy()
    for i in categorical:
        g, h, n = cells[:, i]
        ratio = np.where(n > 0, np.round(g / np.where(h + rules.l2 > 0, h + rules.l2, 1.0), 9), np.inf)
        order[i] = np.lexsort((order[i], ratio))
        cells[:, i] = cells[:, i][:, order[i]]
    left = np.cumsum(cells, axis=2)
    total = left[:, :, -1:]
    right = total - left
    fewest = max(rules.min_leaf_rows, 1)
    valid = (left[2] >= fewest) & (right[2] >= fewest)
    valid &= (left[1] >= rules.min_leaf_hessian) & (right[1] >= rules.min_leaf_hessian)
    gain = _score(*left[:2], rules) + _score(*right[:2], rules) - _score(*total[:2], rules)
    steps = np.where(valid & (gain > rules.min_gain), np.rint(gain / unit), 0)
    feature, at = np.unravel_index(int(np.argmax(steps)), steps.shape)
    if steps[feature, at] < 1:
        return None
    chosen = None
    if feature in set(categorical):
        chosen = tuple(sorted(int(b) for b, n in zip(order[feature][:at + 1], cells[2, feature]) if n > 0))
    return Split(
        float(gain[feature, at]), int(steps[feature, at]), int(feature), int(at), chosen,
        _sums(left[:, feature, at]), _sums(right[:, feature, at]))


def _sums(values) -> Sums:
    return float(values[0]), float(values[1]), int(round(values[2]))


def counted_cells(rows: DataFrame, node: Column, features: Sequence[int]) -> DataFrame:
    """(node, feature, bin, g, h, n): sums of the rows with a node, for the chosen features by their place."""
    bins = F.array(*[F.get("bins", i) for i in features])
    return rows.select(node.alias("node"), bins.alias("bins"), "lambda", "hessian").where("node is not null").select(
        "node", "lambda", "hessian", F.posexplode("bins").alias("feature", "bin"),
    ).groupBy("node", "feature", "bin").agg(
        F.sum("lambda").alias("g"), F.sum("hessian").alias("h"), F.count(F.lit(1)).alias("n"))


def summed_cells(rows: DataFrame, route: Sequence[Node], features: Sequence[int], width: int) -> DataFrame:
    """As ``counted_cells``; each task holds the sums of the wanted nodes as arrays."""
    wanted = sorted({int(n.value) for n in route if n.leaf >= 0 and n.value >= 0})
    place = np.full(wanted[-1] + 2, -1)  # the last place is that of -1, no node
    place[wanted] = np.arange(len(wanted))
    route, features = list(route), list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, len(features), len(wanted) * width), np.int64)  # rows, pulls known, curvatures known
        sums = np.zeros((2, len(features), len(wanted) * width))
        for batch in batches:
            bins = as_matrix(batch.column("bins"))
            node = place[leaf_values(route, bins).astype(np.int64)]
            values = [batch.column(name) for name in ("lambda", "hessian")]
            known = [v.is_valid().to_numpy(zero_copy_only=False) if v.null_count else None for v in values]
            values = [v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in values]
            inside = np.flatnonzero(node >= 0)
            start = node[inside] * width
            for at, feature in enumerate(features):
                cell = start + bins[inside, feature]
                n = np.bincount(cell, minlength=counts.shape[2])
                counts[0, at] += n
                for i in range(2):
                    sums[i, at] += np.bincount(cell, weights=values[i][inside], minlength=counts.shape[2])
                    counts[i + 1, at] += n if known[i] is None else np.bincount(
                        cell[known[i][inside]], minlength=counts.shape[2])
        feature, cell = np.nonzero(counts[0])
        if len(feature):
            n, *known = counts[:, feature, cell]
            g, h = (pa.array(sums[i, feature, cell], mask=known[i] == 0) for i in range(2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(wanted)[cell // width], pa.int32()), pa.array(feature, pa.int32()),
                 pa.array(cell % width, pa.int32()), g, h, pa.array(n, pa.int64())],
                ["node", "feature", "bin", "g", "h", "n"])

    parts = rows.select("bins", "lambda", "hessian").mapInArrow(
        run, "node int, feature int, bin int, g double, h double, n long")
    return parts.groupBy("node", "feature", "bin").agg(*[F.sum(x).alias(x) for x in "ghn"])


@dataclass
class DriverCells:
    """Sums held on the driver, a dense array for each leaf that may still be split."""

    rows: DataFrame
    features: Sequence[int]
    width: int
    rules: Rules
    unit: float
    categorical: Sequence[int]
    held: dict[int, np.ndarray] = field(default_factory=dict)

    def best(self, route: Sequence[Node], pairs: Sequence[tuple[int, int | None, int | None]]) -> dict[int, Split | None]:
        """Best splits of the counted nodes and of their siblings: ``pairs`` are (counted, sibling, parent)."""
        found = summed_cells(self.rows, route, self.features, self.width).toArrow()
        column = {name: found[name].to_numpy() for name in found.column_names}
        place = {counted: i for i, (counted, _, _) in enumerate(pairs)}
        dense = np.zeros((len(pairs), 3, len(self.features), self.width))
        at = np.array([place[x] for x in column["node"]], dtype=np.int64)
        for k, name in enumerate("ghn"):
            dense[at, k, column["feature"], column["bin"]] = column[name]
        out = {}
        for counted, sibling, parent in pairs:
            self.held[counted] = dense[place[counted]]
            out[counted] = self._split(counted)
            if sibling is not None:
                rest = self.held[parent] - self.held[counted]
                self.held[sibling] = np.where(np.rint(rest[2]) > 0, rest, 0.0)
                out[sibling] = self._split(sibling)
        for parent in {p for _, _, p in pairs}:
            self.held.pop(parent, None)
        return out

    def _split(self, node: int) -> Split | None:
        return best_split(self.held[node], self.rules, self.unit, self.categorical)

    def close(self) -> None:
        self.held.clear()


@dataclass
class TableCells:
    """Sums kept as tables, searched by windows over the bins; the driver sees one row for each leaf."""

    rows: DataFrame
    features: Sequence[int]
    width: int
    rules: Rules
    unit: float
    categorical: Sequence[int]
    tables: list[tuple[set[int], DataFrame]] = field(default_factory=list)

    def best(self, route: Sequence[Node], pairs: Sequence[tuple[int, int | None, int | None]]) -> dict[int, Split | None]:
        end = tree_column(route, F.col("bins"))
        cells = counted_cells(self.rows, F.when(end >= 0, end.cast("int")), self.features)
        related = [(c, s, p) for c, s, p in pairs if s is not None]
        if related:
            parts = [cells]
            sibling = _renumbered({c: s for c, s, _ in related})
            minus = [(-F.col(x)).alias(x) for x in "ghn"]
            parts.append(cells.select(sibling.alias("node"), "feature", "bin", *minus).where("node is not null"))
            parents = {p: s for _, s, p in related}
            for nodes, table in self.tables:
                if mine := {p: s for p, s in parents.items() if p in nodes}:
                    parts.append(table.where(F.col("node").isin(list(mine))).withColumn("node", _renumbered(mine)))
            both = parts[0]
            for part in parts[1:]:
                both = both.unionByName(part)
            cells = both.groupBy("node", "feature", "bin").agg(*[F.sum(x).alias(x) for x in "ghn"]).where("n > 0")
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
        known = {x for c, s, _ in pairs for x in (c, s) if x is not None}
        self.tables.append((known, cells))
        out: dict[int, Split | None] = dict.fromkeys(known)
        for row in self._searched(cells).collect():
            out[row["node"]] = self._split(cells, row)
        return out

    def _searched(self, cells: DataFrame) -> DataFrame:
        rules = self.rules
        is_category = F.col("feature").isin(list(self.categorical)) if self.categorical else F.lit(False)
        total = F.col("h") + rules.l2
        ratio = F.when(is_category, F.round(F.col("g") / F.when(total > 0, total).otherwise(1.0), 9)).otherwise(0.0)
        group = Window.partitionBy("node", "feature")
        to_here = group.orderBy("ratio", "bin").rowsBetween(Window.unboundedPreceding, 0)
        rows = cells.withColumn("ratio", ratio).withColumns(
            {f"{x}l": F.sum(x).over(to_here) for x in "ghn"}
        ).withColumn("place", F.row_number().over(group.orderBy("ratio", "bin"))).withColumns(
            {f"{x}r": F.sum(x).over(group) - F.col(f"{x}l") for x in "ghn"})

        def score(g: Column, h: Column) -> Column:
            shrunk = F.greatest(F.abs(g) - rules.l1, F.lit(0.0))
            return F.when(h + rules.l2 > 0, shrunk * shrunk / (h + rules.l2)).otherwise(0.0)

        gl, gr, hl, hr = (F.col(x) for x in ("gl", "gr", "hl", "hr"))
        gain = score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr)
        fewest = max(rules.min_leaf_rows, 1)
        valid = rows.withColumns({"gain": gain, "steps": F.rint(gain / F.lit(self.unit))}).where(
            (F.col("nl") >= fewest) & (F.col("nr") >= fewest) & (hl >= rules.min_leaf_hessian)
            & (hr >= rules.min_leaf_hessian) & (F.col("gain") > rules.min_gain) & (F.col("steps") >= 1))
        order = F.struct((-F.col("steps")).alias("o"), "feature", "place")
        kept = F.struct("steps", "gain", "feature", "bin", "place", "gl", "hl", "nl", "gr", "hr", "nr")
        return valid.groupBy("node").agg(F.min_by(kept, order).alias("s")).select("node", "s.*")

    def _split(self, cells: DataFrame, row) -> Split:
        chosen = None
        if row["feature"] in self.categorical:
            total = F.col("h") + self.rules.l2
            ratio = F.round(F.col("g") / F.when(total > 0, total).otherwise(1.0), 9)
            mine = cells.where((F.col("node") == row["node"]) & (F.col("feature") == row["feature"]))
            chosen = tuple(sorted(r["bin"] for r in mine.orderBy(ratio, "bin").limit(row["place"]).collect()))
        return Split(
            row["gain"], int(row["steps"]), row["feature"], row["bin"], chosen,
            (row["gl"], row["hl"], row["nl"]), (row["gr"], row["hr"], row["nr"]))

    def close(self) -> None:
        for _, table in self.tables:
            table.unpersist()


def _renumbered(numbers: Mapping[int, int]) -> Column:
    out = F.lit(None).cast("int")
    for old, new in numbers.items():
        out = F.when(F.col("node") == old, F.lit(new)).otherwise(out)
    return out


# -- growth ------------------------------------------------------------------------

@dataclass
class _Leaf:
    """A node of the tree in the making."""

    path: str
    sums: Sums | None = None
    split: Split | None = None
    searched: bool = False
    children: tuple[int, int] | None = None

    @property
    def order(self) -> tuple:
        return -self.split.steps, len(self.path), self.path


def _picked(leaves: list[_Leaf], rules: Rules) -> tuple[list[int], list[int]]:
    """The nodes that best-first growth splits, as far as is known, and the ones to be searched before it is sure."""
    frontier, picked, unsure = {0}, [], []
    while len(frontier) < rules.num_leaves:
        able = [i for i in frontier if leaves[i].split is not None]
        if not able:
            break
        best = min(able, key=lambda i: leaves[i].order)
        leaf = leaves[best]
        if leaf.children is None:
            leaf.children = len(leaves), len(leaves) + 1
            for side, sums in (("L", leaf.split.left), ("R", leaf.split.right)):
                leaves.append(_Leaf(leaf.path + side, sums, searched=not rules.may_split(sums, len(leaf.path) + 1)))
        picked.append(best)
        frontier.remove(best)
        frontier.update(leaf.children)
        if len(frontier) < rules.num_leaves:
            unsure += [i for i in leaf.children if not leaves[i].searched]
    return picked, unsure


def grow_tree(
    rows: DataFrame, binning: Binning, rules: Rules, n_rows: int, features: Sequence[int] | None = None,
) -> tuple[list[Node], list[Node]]:
    """A tree on rows (bins, lambda, hessian): nodes on raw values, and the same nodes on bins. Leaves have Newton steps."""
    features = list(range(len(binning.edges))) if features is None else list(features)
    categorical = [k for k, i in enumerate(features) if i in binning.categories]
    unit = GAIN_STEP * max(n_rows, 1)
    on_driver = len(features) * binning.width * (2 * rules.num_leaves + 2) <= DRIVER_CELLS
    cells = (DriverCells if on_driver else TableCells)(rows, features, binning.width, rules, unit, categorical)
    leaves = [_Leaf("")]
    try:
        leaves[0].split = cells.best([Node(leaf=0)], [(0, None, None)])[0]
        leaves[0].searched = True
        while True:
            picked, unsure = _picked(leaves, rules)
            if not unsure:
                break
            pairs, waiting = [], set(unsure)
            for at in picked:
                mine = waiting & set(leaves[at].children)
                if not mine:
                    continue
                small, big = sorted(leaves[at].children, key=lambda i: (leaves[i].sums[2], i))
                pairs.append((small, big if big in mine else None, at))
            route = _routed(leaves, features, {small for small, _, _ in pairs})
            for at, split in cells.best(route, pairs).items():
                if at in waiting:
                    leaves[at].split, leaves[at].searched = split, True
    finally:
        cells.close()
    if leaves[0].sums is None:
        split = leaves[0].split
        leaves[0].sums = tuple(a + b for a, b in zip(split.left, split.right)) if split else (0.0, 0.0, 0)
    return _as_nodes(leaves, set(picked), features, binning, rules)


def _routed(leaves: list[_Leaf], features: Sequence[int], wanted: set[int]) -> list[Node]:
    """A tree on bins whose ends have the number of the wanted node that a row falls into, or -1."""
    route: list[Node] = []

    def visit(at: int) -> int:
        place, leaf = len(route), leaves[at]
        route.append(Node(leaf=0, value=float(at if at in wanted else -1)))
        if at in wanted or leaf.children is None:
            return place
        left, right = (visit(child) for child in leaf.children)
        if all(route[x].leaf == 0 and route[x].value < 0 for x in (left, right)):
            del route[place + 1:]  # no wanted node below
            return place
        split = leaf.split
        categories = None if split.categories is None else [float(c) for c in split.categories]
        route[place] = Node(features[split.feature], float(split.bin), categories, left, right)
        return place

    visit(0)
    return route


def _as_nodes(leaves, picked, features, binning, rules) -> tuple[list[Node], list[Node]]:
    raw: list[Node] = []
    binned: list[Node] = []
    ends = 0

    def visit(at: int) -> int:
        nonlocal ends
        place, leaf = len(raw), leaves[at]
        raw.append(Node())
        binned.append(Node())
        if at not in picked:
            raw[place] = Node(leaf=ends, value=newton_step(*leaf.sums[:2], rules.l1, rules.l2))
            ends += 1
        else:
            split, feature = leaf.split, features[leaf.split.feature]
            node = Node(feature=feature, gain=split.gain, threshold=float(split.bin))
            if split.categories is not None:
                node.categories, node.threshold = [float(c) for c in split.categories], 0.0
            raw[place] = node
            node.left, node.right = (visit(child) for child in leaf.children)
        binned[place] = replace(raw[place])
        if raw[place].feature >= 0 and raw[place].categories is None:
            edges = binning.edges[raw[place].feature]
            at_bin = int(binned[place].threshold)
            raw[place].threshold = edges[at_bin] if at_bin < len(edges) else math.inf  # only missing values go right
        return place

    visit(0)
    return raw, binned

"""Randomised clustering trees, grown a level at a time: all nodes of a level at once, as Spark aggregates.

Three kinds of tests send a row left: TERC x[dim1] <= threshold; TCMP x[dim1] <= x[dim2]; TPC projection . x <= threshold.
Node tables (``visbag.schema.NODES``) are small: a level has at most 2^depth nodes. Randomness is seeded. Words are numbered
depth-first, left to right.

With random thresholds a level is one pass over the rows (see ``_histograms``): for each node and test the counts of the
labels on the left and what the left child's own tests will be drawn from. Tasks' histograms merge by addition; the right
child is its parent less the left one. PCA and LDP directions take a second pass for the products of the smaller of two
siblings, the larger is again a difference. Best thresholds take passes for statistics, for the tests' values (which are
shuffled) and for counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NODES
from ..scratch import written
from . import information

LEAST_SCORE, AT_ONCE, CELLS, PARTS = 1e-6, 256, 1 << 22, 64
BINS, MOST = 500, 5.0  # fixed values, like the half step of the tail table below
KINDS = ("TERC", "TCMP", "TPC")


def tail(point: float) -> float:
    """Normal mass beyond |point| deviations, from a table of BINS steps up to MOST; 0 beyond."""
    at = int(abs(point) / MOST * (BINS - 1) + 0.5)
    return float(_tail_table()[at]) if at < BINS else 0.0


def _tail_table() -> np.ndarray:
    o = np.arange(BINS) / (BINS - 1) * MOST
    mass = np.exp(-o * o / 2) / 2.506628274 * (MOST / (BINS - 0.5))
    mass[0] /= 2
    return np.cumsum(mass[::-1])[::-1].astype(np.float32)


def _values(x: np.ndarray, kind: str, test: dict) -> np.ndarray:
    """What is compared with the threshold (of TCMP: with 0)."""
    if kind == "TERC":
        return x[:, test["dim1"]].astype(np.float64)
    if kind == "TCMP":
        return x[:, test["dim1"]].astype(np.float64) - x[:, test["dim2"]]
    return (x * np.asarray(test["projection"], np.float64)).sum(1)  # a row's value does not depend on the rows beside it


def _left(x: np.ndarray, kind: str, tests: list[dict]) -> np.ndarray:
    """Tests x rows: which rows go left."""
    return np.array([_values(x, kind, t) <= t["threshold"] for t in tests]).reshape(len(tests), len(x))


class NodeStats:
    """What a node's own rows give its tests: count, sums, sums of squares, drawn rows, counts of labels, and for directions
    the sums of products and of each class."""

    def __init__(self, dims: int):
        self.n, self.sums, self.squares, self.products, self.drawn, self.classes, self.labels = 0.0, np.zeros(dims), np.zeros(dims), None, np.zeros((0, dims)), {}, {}

    def less(self, other: NodeStats) -> NodeStats:
        """The statistics of the rows that are not ``other``'s (drawn rows apart)."""
        out = NodeStats(len(self.sums))
        out.n, out.sums, out.squares = self.n - other.n, self.sums - other.sums, self.squares - other.squares
        out.labels = {c: n - other.labels.get(c, 0) for c, n in self.labels.items() if n > other.labels.get(c, 0)}
        if self.products is not None and other.products is not None:
            out.products = self.products - other.products
            out.classes = {c: v - other.classes[c] if c in other.classes else v for c, v in self.classes.items() if c in out.labels}
        return out

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares / max(self.n, 1) - self.mean**2, 0))

    def directions(self, method: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Eigenvalues, the largest first, and directions (rows): of the covariance (PCA), or of the scatter of all
        pairs over that of pairs of one class (LDP). None if there are none."""
        total = self.products / self.n - np.outer(self.mean, self.mean)
        if method == "PCA":
            values, vectors = np.linalg.eigh(total)
            return values[::-1], vectors.T[::-1]
        within = self.products / self.n - sum(np.outer(c[1:], c[1:]) / c[0] for c in self.classes.values()) / self.n
        trace = float(np.trace(within)) / len(within)
        if trace <= 0 or len(self.classes) < 2:
            return None
        white = np.linalg.inv(np.linalg.cholesky(within + 1e-6 * trace * np.eye(len(within))))
        values, vectors = np.linalg.eigh(white @ total @ white.T)
        rows = (white.T @ vectors[:, ::-1]).T
        return values[::-1], rows / np.linalg.norm(rows, axis=1, keepdims=True)


def wheel(rng, values: np.ndarray, most: int) -> int:
    """A roulette wheel: a place drawn by the squares of the first ``most`` values, negative ones read as 0."""
    upto = np.cumsum(np.maximum(values[:most], 0) ** 2)
    return int(min(np.searchsorted(upto, rng.random() * upto[-1]), len(upto) - 1))


def _tests(rng, kind: str, dims: int, tries: int, stats: NodeStats | None, method: str) -> list[dict]:
    """The tests that a node tries, in order."""
    out, chosen = [], None
    if kind == "TPC" and method in ("PCA", "LDP"):
        found = stats.directions(method)
        if found is None or found[0][0] <= 1e-5:
            return []
        chosen = found[1][wheel(rng, found[0], tries)]
    for _ in range(tries):
        if kind == "TERC":
            d = int(rng.integers(dims))
            out.append({"dim1": d, "threshold": float(rng.normal(stats.mean[d], stats.deviation[d]))})
        elif kind == "TCMP":
            a, b = rng.choice(dims, 2, replace=dims < 2)
            out.append({"dim1": int(a), "dim2": int(b), "threshold": 0.0})
        else:
            p = chosen if chosen is not None else rng.standard_normal(dims)
            p = p / max(np.linalg.norm(p), 1e-12)
            out.append({"projection": p.tolist(), "threshold": float(_values(stats.drawn[int(rng.integers(len(stats.drawn)))][None], kind, {"projection": p})[0])})
    return out


_STATS = "node int, what int, label int, key bigint, v array<double>"


def _node_stats(rows: DataFrame, kind: str, decided: list, wanted: list[int], dims: int, draws: int, products: bool, classes: bool = False) -> dict[int, NodeStats]:
    """Statistics of the nodes ``wanted``: sums by task, then by node (with ``products`` or ``classes`` by label too);
    ``draws`` rows of each, by their hash."""
    decided, wanted = list(decided), set(wanted)
    own = pa.schema([("node", pa.int32()), ("what", pa.int32()), ("label", pa.int32()), ("key", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        drawn: dict[int, tuple] = {}
        for batch in batches:
            x, labels, keys = _batches(batch, "x"), batch.column("label").to_numpy(), batch.column("key").to_numpy()
            at = _descend(x, kind, decided)
            for n in wanted & set(np.unique(at).tolist()):
                here = np.flatnonzero(at == n)
                v = x[here]
                parts = {(n, 0, 0): np.concatenate([[len(v)], v.sum(0), (v * v).sum(0)])}
                if products:
                    parts[n, 1, 0] = (v.T @ v).reshape(-1)
                if products or classes:
                    for c in np.unique(labels[here]).tolist():
                        mine = v[labels[here] == c]
                        parts[n, 2, c] = np.concatenate([[len(mine)], mine.sum(0)])
                for k, p in parts.items():
                    sums[k] = sums[k] + p if k in sums else p
                if draws:
                    k, r = (np.concatenate(z) for z in zip((keys[here], v), drawn[n])) if n in drawn else (keys[here], v)
                    least = np.argsort(k, kind="stable")[:draws]
                    drawn[n] = k[least], r[least]
        found = [(n, w, c, 0, v.tolist()) for (n, w, c), v in sums.items()] + [(n, 3, 0, k, r.tolist()) for n, (ks, rs) in drawn.items() for k, r in zip(ks.tolist(), rs)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], own[i].type) for i in range(5)], schema=own)

    def added(table: pa.Table) -> pa.Table:
        if table.column("what")[0].as_py() == 3:
            return table.sort_by("key").slice(0, draws)
        v = np.array(table.column("v").to_pylist()).sum(0)
        return pa.table([*(table.column(c)[:1] for c in ("node", "what", "label", "key")), pa.array([v.tolist()], pa.list_(pa.float64()))], schema=own)

    out: dict[int, NodeStats] = {}
    for r in rows.mapInArrow(run, _STATS).groupBy("node", "what", "label").applyInArrow(added, _STATS).collect():  # of AT_ONCE nodes at most
        node, v = out.setdefault(r.node, NodeStats(dims)), np.array(r.v)
        if r.what == 0:
            node.n, node.sums, node.squares = v[0], v[1 : dims + 1], v[dims + 1 :]
        elif r.what == 1:
            node.products = v.reshape(dims, dims)
        elif r.what == 2:
            node.classes[r.label], node.labels[r.label] = v, int(v[0])
        else:
            node.drawn = np.vstack([node.drawn, v])
    return out


def _batches(batch: pa.RecordBatch, column: str) -> np.ndarray:
    c = batch.column(column)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


_HISTOGRAM = "node int, test int, part int, key bigint, counts array<bigint>, v array<double>"


def _histograms(rows: DataFrame, kind: str, decided: list, tests: dict[int, list[dict]], stats: dict[int, NodeStats], moments: bool, draws: int) -> DataFrame:
    """One pass over the rows, written. node, test, counts (of the node's labels in their order, on the left of the test), v
    (with ``moments``, the sums and sums of squares there). For test -1: key and v of the rows that are among the
    first ``draws`` on a side of a test by their hash, so that either child's drawn rows are among them.

    Histograms merge twice, by parts of the tasks and then in all, so that no group holds an array of each task."""
    decided, labels = list(decided), {n: np.array(sorted(stats[n].labels), np.int64) for n in tests}
    own = pa.schema([("node", pa.int32()), ("test", pa.int32()), ("part", pa.int32()), ("key", pa.int64()), ("counts", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))])

    def first(n: int, keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        left = _left(x[order], kind, tests[n])
        kept = order[(left & (left.cumsum(1) <= draws) | ~left & ((~left).cumsum(1) <= draws)).any(0)]
        return keys[kept], x[kept]

    def run(batches):
        counts, sums, pools = {}, {}, {}
        for batch in batches:
            x, label, keys = _batches(batch, "x"), batch.column("label").to_numpy(), batch.column("key").to_numpy()
            at = _descend(x, kind, decided)
            for n in np.unique(at).tolist():
                if n not in tests:
                    continue
                here = np.flatnonzero(at == n)
                v, many, wide = x[here], len(tests[n]), len(labels[n])
                left = _left(v, kind, tests[n])
                t, r = np.nonzero(left)
                found = np.bincount(t * wide + np.searchsorted(labels[n], label[here])[r], minlength=many * wide).reshape(many, wide)
                counts[n] = counts[n] + found if n in counts else found
                if moments:
                    found = left.astype(np.float64) @ np.hstack([v, v * v])
                    sums[n] = sums[n] + found if n in sums else found
                if draws:
                    pools[n] = first(n, *(np.concatenate(z) for z in zip(pools[n], (keys[here], v)))) if n in pools else first(n, keys[here], v)
        part = TaskContext.get().partitionId() % PARTS
        for n, c in counts.items():
            v = sums[n].tolist() if moments else [None] * len(c)
            yield pa.RecordBatch.from_pylist([dict(zip(own.names, (n, t, part, None, k, v[t]))) for t, k in enumerate(c.tolist())], own)
        for n, (keys_, x) in pools.items():
            yield pa.RecordBatch.from_pylist([dict(zip(own.names, (n, -1, part, k, None, v))) for k, v in zip(keys_.tolist(), x.tolist())], own)

    def merged(table: pa.Table) -> pa.Table:
        if table.column("test")[0].as_py() < 0:
            n, part = table.column("node")[0].as_py(), table.column("part")[0].as_py()
            keys, x = first(n, table.column("key").to_numpy(), np.array(table.column("v").to_pylist()))
            return pa.Table.from_pylist([dict(zip(own.names, (n, -1, part, k, None, v))) for k, v in zip(keys.tolist(), x.tolist())], own)
        c = np.array(table.column("counts").to_pylist()).sum(0).tolist()
        v = np.array(table.column("v").to_pylist()).sum(0).tolist() if moments else None
        return pa.table([*(table.column(k)[:1] for k in ("node", "test", "part", "key")), pa.array([c], own.field("counts").type), pa.array([v], own.field("v").type)], schema=own)

    parts = rows.mapInArrow(run, _HISTOGRAM).groupBy("node", "test", "part").applyInArrow(merged, _HISTOGRAM)
    return written(parts.groupBy("node", "test").applyInArrow(merged, _HISTOGRAM))


def _sides(found: DataFrame, stats: dict[int, NodeStats], nodes: list[int]) -> DataFrame:
    """node, test, label, left, right of histograms: what is not on the left is on the right."""
    totals = [(n, labels, [stats[n].labels[c] for c in labels]) for n in nodes for labels in [sorted(stats[n].labels)]]
    spark = found.sparkSession
    own = spark.createDataFrame(totals, "node int, labels array<int>, totals array<bigint>")  # of the level's nodes
    cells = found.where("test >= 0").join(F.broadcast(own), "node").select("node", "test", F.inline(F.arrays_zip("labels", "counts", "totals")))
    return cells.select("node", "test", F.col("labels").alias("label"), F.col("counts").alias("left"), (F.col("totals") - F.col("counts")).alias("right"))


def _children(found: DataFrame, kind: str, decided: list, chosen: dict[int, int], stats: dict[int, NodeStats], dims: int, moments: bool, draws: int) -> dict[int, NodeStats]:
    """Statistics of the children of nodes whose test has been chosen, from the histograms: the left child's cell, and the
    parent less that."""
    out: dict[int, NodeStats] = {}
    spark = found.sparkSession
    taken = spark.createDataFrame(sorted(chosen.items()), "node int, test int")
    for r in found.join(F.broadcast(taken), ["node", "test"]).select("node", "counts", "v").collect():  # a cell a node of the level
        left, parent = NodeStats(dims), stats[r.node]
        left.labels = {c: n for c, n in zip(sorted(parent.labels), r.counts) if n}
        left.n = float(sum(r.counts))
        if moments:
            left.sums, left.squares = np.array(r.v[:dims]), np.array(r.v[dims:])
        test = decided[r.node]
        out[test["left_node"]], out[test["right_node"]] = left, parent.less(left)
    if draws:
        decided_ = {n: decided[n] for n in chosen}
        schema = pa.schema([("node", pa.int32()), ("key", pa.int64()), ("v", pa.list_(pa.float64()))])

        def dealt(batches):
            for batch in batches:
                x, own = _batches(batch, "v"), batch.column("node").to_numpy().copy()
                for n in np.unique(own).tolist():
                    here = np.flatnonzero(own == n)
                    left = _left(x[here], kind, [decided_[n]])[0]
                    own[here] = np.where(left, decided_[n]["left_node"], decided_[n]["right_node"])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("key"), batch.column("v")], schema=schema)

        pool = found.where("test = -1").join(F.broadcast(taken.select("node")), "node", "left_semi").select("node", "key", "v")
        kept = pool.mapInArrow(dealt, "node int, key bigint, v array<double>").groupBy("node").applyInArrow(lambda t: t.sort_by("key").slice(0, draws), "node int, key bigint, v array<double>")
        for n, of in _by(kept.collect(), "node").items():
            out[n].drawn = np.array([r.v for r in sorted(of, key=lambda r: r.key)])
    return out


def _by(rows: list, key: str) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def _with_products(rows: DataFrame, kind: str, decided: list, parents: dict[int, NodeStats], children: dict[int, NodeStats], dims: int) -> None:
    """Adds the products and class sums of the children: those of the smaller sibling are summed, the larger is the rest."""
    pairs = [(p, decided[p]["left_node"], decided[p]["right_node"]) for p in parents]
    small = {p: min(sides, key=lambda c: children[c].n) for p, *sides in pairs}
    for at in range(0, len(pairs), AT_ONCE):
        part = pairs[at : at + AT_ONCE]
        found = _node_stats(rows, kind, decided, [small[p] for p, *_ in part], dims, 0, True)
        for p, *sides in part:
            summed = found[small[p]]
            for c in sides:
                own = summed if c == small[p] else parents[p].less(summed)
                own.drawn = children[c].drawn
                children[c] = own


def _taken(scored: list[tuple[int, float]], least: float) -> tuple[int, float] | None:
    """The first test to score ``least``, else the best; None if none is over LEAST_SCORE."""
    good = next(((t, s) for t, s in sorted(scored) if s >= least), None) or max(scored, key=lambda x: (x[1], -x[0]), default=None)
    return good if good and good[1] > LEAST_SCORE else None


def _raw(samples: DataFrame, kind: str, tries: int, levels: int, least: float, method: str, random_threshold: bool, directions: str, seed: int, column: str, label: str, tree: int, classes: int, given: Callable[[int], list[dict]] | None = None) -> list[dict]:
    """The nodes with leaves; inner ones with their test's number and score, and unless thresholds are the best ones,
    how many rows go left and right."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")
    information.checked(method)
    if method == "ScWithError" and (random_threshold or kind == "TCMP"):
        raise ValueError("ScWithError scores orders of values: it needs random_threshold=False")
    if directions not in ("", "RND", "RANDOM", "PCA", "LDP"):
        raise ValueError(f"unknown directions {directions!r}")
    from .statistics import label_subset

    rows = label_subset(samples.where(F.col(column).isNotNull() & F.col(label).isNotNull()), label, classes, seed)
    rows = rows.select(F.col(label).cast("int").alias("label"), F.col(column).alias("x"), F.xxhash64(F.col(column), F.lit(seed)).alias("key"))
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return []
    dims, rng = first.n, np.random.default_rng(seed)
    at_random = random_threshold or kind == "TCMP"
    moments, draws = kind == "TERC" and given is None, tries if kind == "TPC" and given is None else 0
    products = kind == "TPC" and directions in ("PCA", "LDP") and given is None
    nodes: list[dict] = [{"tree": tree, "node": 0, "path": 1}]
    decided: list[dict | None] = [None]
    level, stats = [0], {}
    if at_random:
        stats = _node_stats(rows, kind, decided, [0], dims, draws, products, classes=True)
    at_once = max(1, CELLS // (tries * (2 * dims + len(stats[0].labels)))) if at_random else AT_ONCE
    for depth in range(levels):
        following, before, later = [], list(decided), {}
        for at in range(0, len(level), at_once):
            own = level[at : at + at_once]
            if not at_random:
                stats = _node_stats(rows, kind, before, own, dims, draws, products)
            tests = {n: given(nodes[n]["path"]) if given else _tests(rng, kind, dims, tries, stats[n], directions) for n in own if n in stats and stats[n].n >= 2}
            tests = {n: t for n, t in tests.items() if t}
            if not tests:
                continue
            if at_random:
                found = _histograms(rows, kind, before, tests, stats, moments, draws)
                sides = _sides(found, stats, list(tests))
            else:
                tests, scores = _best_thresholds(rows, kind, before, tests, method)
                sides = _counts(rows, kind, before, tests) if method != "ScWithError" else None
            if sides is not None:
                scores = {(r.node, r.test): r.score for r in information.split_scores(sides, method, "node", "test").where("score is not null").collect()}
            of: dict[int, list] = {}
            for (n, t), s in scores.items():
                of.setdefault(n, []).append((t, s))
            chosen = {}
            for n in own:
                good = _taken(of.get(n, []), least)
                if good is None:
                    continue
                chosen[n] = good[0]
                nodes[n] |= tests[n][good[0]] | {"left_node": len(nodes), "right_node": len(nodes) + 1, "test": good[0], "score": good[1]}
                decided[n] = nodes[n]
                following += [len(nodes), len(nodes) + 1]
                nodes += [{"tree": tree, "node": len(nodes) + i, "path": 2 * nodes[n]["path"] + i} for i in (0, 1)]
                decided += [None, None]
            if at_random and chosen:
                children = _children(found, kind, decided, chosen, stats, dims, moments, draws)
                for n in chosen:
                    nodes[n] |= {"left_rows": int(children[nodes[n]["left_node"]].n), "right_rows": int(children[nodes[n]["right_node"]].n)}
                if products and depth + 1 < levels:
                    _with_products(rows, kind, decided, {n: stats[n] for n in chosen}, children, dims)
                later |= children
        level = following
        if at_random:
            stats = later
        if not level:
            break
    if kind == "TPC":
        _deviations(rows, decided, nodes)
    return nodes


def grown(samples: DataFrame, kind: str, tries: int = 20, levels: int = 8, least: float = 1.0, method: str = "Sc", random_threshold: bool = True, directions: str = "", seed: int = 1, column: str = "descriptor", label: str = "label", tree: int = 0, classes: int = 0, given: Callable[[int], list[dict]] | None = None) -> list[dict]:
    """Node rows of one tree. ``least``: of the tests in order, the first to score it is taken, else the best.

    A node stays a leaf at the last level, with fewer than 2 rows, or if no test scores over LEAST_SCORE. Thresholds and
    directions come from the node's own rows: TERC draws from a normal of their mean and deviation in the dimension, TPC
    takes the projected value of one of them. ``directions`` (TPC): "" or RND or RANDOM for random ones; PCA or LDP for
    one of the node's leading ones, drawn by a roulette wheel. ``random_threshold`` False: each test's threshold is the
    best one for it. ``classes``: only rows of so many drawn labels (below 2: of all). ``given``: the tests of a node by its
    path (1 the root, 2p and 2p + 1 the children of p), ``tries`` at most, in place of drawn ones.

    A level's nodes are taken so many at a time that their histograms hold CELLS numbers a task (AT_ONCE nodes at a time
    for best thresholds), so what tasks and the driver hold does not grow with the depth.
    """
    return assign_words(_folded(_raw(samples, kind, tries, levels, least, method, random_threshold, directions, seed, column, label, tree, classes, given)))


def chosen_tests(samples: DataFrame, kind: str, given: Callable[[int], list[dict]], tries: int, levels: int = 8, least: float = 1.0, method: str = "Sc", column: str = "descriptor", label: str = "label") -> list[dict]:
    """What growing with ``given`` tests decides: path, test, score, left_rows, right_rows of the inner nodes."""
    nodes = _raw(samples, kind, tries, levels, least, method, True, "", 1, column, label, 0, 0, given)
    return [{k: n[k] for k in ("path", "test", "score", "left_rows", "right_rows")} for n in nodes if "test" in n]


def _descend(x: np.ndarray, kind: str, decided: list) -> np.ndarray:
    """The undecided node that each row reaches."""
    at = np.zeros(len(x), np.int64)
    for n, test in enumerate(decided):  # children come after their parents
        if test is not None:
            here = np.flatnonzero(at == n)
            if len(here):
                left = _values(x[here], kind, test) <= test["threshold"]
                at[here] = np.where(left, test["left_node"], test["right_node"])
    return at


def _counts(rows: DataFrame, kind: str, decided: list, tests: dict[int, list[dict]]) -> DataFrame:
    """node, test, label, left, right: a partial count a task, then a sum."""
    decided = list(decided)

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x, labels = _batches(batch, "x"), batch.column("label").to_numpy()
            at = _descend(x, kind, decided)
            for n in np.unique(at).tolist():
                here = np.flatnonzero(at == n)
                for t, test in enumerate(tests.get(n, ())):
                    left = _values(x[here], kind, test) <= test["threshold"]
                    for c in np.unique(labels[here]).tolist():
                        own = labels[here] == c
                        sides = total.setdefault((n, t, c), np.zeros(2, np.int64))
                        sides += (int((own & left).sum()), int((own & ~left).sum()))
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.int32()) for i in range(3)), *(pa.array([int(v[i]) for v in total.values()], pa.int64()) for i in (0, 1))], ["node", "test", "label", "left", "right"])

    parts = rows.select("label", "x").mapInArrow(run, "node int, test int, label int, left bigint, right bigint")
    return parts.groupBy("node", "test", "label").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))


def _best_thresholds(rows: DataFrame, kind: str, decided: list, tests: dict[int, list[dict]], method: str) -> tuple[dict, dict]:
    """The tests with their best thresholds, and the scores of these by (node, test)."""
    decided, width = list(decided), max(map(len, tests.values()))

    def run(batches):
        for batch in batches:
            x, labels = _batches(batch, "x"), batch.column("label")
            at = _descend(x, kind, decided)
            for n in np.unique(at).tolist():
                here = np.flatnonzero(at == n)
                for t, test in enumerate(tests.get(n, ())):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), n * width + t)), labels.take(pa.array(here)), pa.array(_values(x[here], kind, test))], ["node", "label", "val"])

    values = rows.select("label", "x").mapInArrow(run, "node bigint, label int, val double")
    best = {r.node: r for r in information.best_threshold(values, method).collect()}
    better = {n: [test | {"threshold": float(best[n * width + t].threshold if n * width + t in best else test["threshold"])} for t, test in enumerate(own)] for n, own in tests.items()}
    return better, {(k // width, k % width): r.score for k, r in best.items()}


def _deviations(rows: DataFrame, decided: list, nodes: list[dict]) -> None:
    """The mean class deviation of each TPC node's projection."""
    decided_ = list(decided)

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x, labels = _batches(batch, "x"), batch.column("label").to_numpy()
            at = np.zeros(len(x), np.int64)
            for n, test in enumerate(decided_):
                if test is None:
                    continue
                here = np.flatnonzero(at == n)
                if len(here):
                    v = _values(x[here], "TPC", test)
                    for c in np.unique(labels[here]).tolist():
                        own = v[labels[here] == c]
                        total.setdefault((n, c), np.zeros(3)).__iadd__((len(own), own.sum(), (own * own).sum()))
                    at[here] = np.where(v <= test["threshold"], test["left_node"], test["right_node"])
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)), *(pa.array([float(v[i]) for v in total.values()]) for i in range(3))], ["node", "label", "n", "s", "q"])

    parts = rows.select("label", "x").mapInArrow(run, "node int, label int, n double, s double, q double")
    sums = parts.groupBy("node", "label").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(1e-10)))
    for r in sums.groupBy("node").agg(F.avg(spread).alias("d")).collect():
        nodes[r.node]["deviation"] = float(r.d)


def _folded(nodes: list[dict]) -> list[dict]:
    """Only inner nodes stay; a missing child is a word. A tree without inner nodes keeps its root."""
    inner = [n for n in nodes if "left_node" in n] or nodes[:1]
    number = {n["node"]: i for i, n in enumerate(inner)}
    return [{f.name: n.get(f.name) for f in NODES} | {"node": i, "left_node": number.get(n.get("left_node")), "right_node": number.get(n.get("right_node"))} for i, n in enumerate(inner)]


def assign_words(nodes: list[dict], first: int = 0) -> list[dict]:
    """Leaves numbered depth-first, left before right, over all trees in order."""
    out = [dict(n) for n in nodes]
    by = {(n["tree"], n["node"]): n for n in out}
    for tree in sorted({n["tree"] for n in out}):
        stack: list = [(0, None)]
        while stack:
            node, side = stack.pop()
            n = by[tree, node]
            if side is not None:
                n[side], first = first, first + 1
                continue
            right, left = n["right_node"], n["left_node"]
            stack.append((right, None) if right is not None else (node, "right_word"))
            stack.append((left, None) if left is not None else (node, "left_word"))
    return out


def rightmost_word(nodes: list[dict]) -> int:
    return max(max(n["left_word"] or 0, n["right_word"] or 0) for n in nodes)


def frame(spark, nodes: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(n.get(f.name) for f in NODES) for n in nodes], NODES)


def words(rows: DataFrame, nodes: list[dict], kind: str, column: str = "descriptor") -> DataFrame:
    """``rows`` with tree_words: for each tree the leaf word, by hard descent; null for null vectors."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n

    def run(batches):
        for batch in batches:
            c = batch.column(column)
            there = np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False))
            x = c.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), -1) if len(there) else np.zeros((0, 1))
            out: list = [None] * len(c)
            found = []
            for tree in sorted(trees):
                word = np.full(len(there), -1, np.int64)
                stack = [(0, np.arange(len(there)))]
                while stack:
                    at, here = stack.pop()
                    if not len(here):
                        continue
                    n = trees[tree][at]
                    test = n if n["threshold"] is not None else n | {"threshold": 0.0}
                    left = _values(x[here], kind, test) <= test["threshold"] if n["dim1"] is not None or n["projection"] is not None else np.ones(len(here), bool)
                    for side, mask in (("left", left), ("right", ~left)):
                        if n[f"{side}_node"] is None:
                            word[here[mask]] = n[f"{side}_word"]
                        else:
                            stack.append((n[f"{side}_node"], here[mask]))
                found.append(word)
            for i, w in zip(there.tolist(), np.array(found).T.tolist() if found else []):
                out[i] = w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "tree_words"])

    return rows.mapInArrow(run, rows.withColumn("tree_words", F.expr("cast(null as array<int>)")).schema)


def descended(rows: DataFrame, nodes: DataFrame, key: str, column: str, levels: int = 16) -> DataFrame:
    """key, tree, word of single-dimension trees by built-in joins alone: one broadcast join a level."""
    at = rows.select(key, column).join(F.broadcast(nodes.select("tree").distinct())).withColumns({"node": F.lit(0), "word": F.lit(None).cast("int")})
    table = nodes.select("tree", "node", "left_node", "right_node", "left_word", "right_word", "dim1", "dim2", "threshold")
    for _ in range(levels):
        value = F.get(column, F.col("dim1"))
        left = F.when(F.col("dim2").isNull(), value <= F.col("threshold")).otherwise(value <= F.get(column, F.col("dim2")))
        step = at.join(F.broadcast(table), ["tree", "node"], "left")
        at = step.select(key, column, "tree", F.when(left, F.col("left_node")).otherwise(F.col("right_node")).alias("_n"), F.coalesce("word", F.when(F.col("dim1").isNull(), None).when(left, F.when(F.col("left_node").isNull(), F.col("left_word"))).otherwise(F.when(F.col("right_node").isNull(), F.col("right_word")))).alias("word")).withColumnRenamed("_n", "node")
    return at.select(key, "tree", "word")


def soft_words(rows: DataFrame, nodes: list[dict], slots: int, column: str = "descriptor", key: str = "feature_id", seed: int | None = 1) -> DataFrame:
    """``rows`` with word_weights, an array of (word, weight), of TPC trees: each row's probability of each leaf by the
    normal tail of its distance to the thresholds. With a seed, ``slots`` words a tree are drawn; without, expected."""
    trees: dict[int, dict[int, dict]] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n

    def weights(x: np.ndarray, rng) -> list[dict]:
        total: dict[int, float] = {}
        for tree in trees.values():
            stack = [(0, float(slots))]
            while stack:
                at, share = stack.pop()
                n = tree[at]
                v = float(np.asarray(n["projection"], np.float64) @ x) - n["threshold"] if n["projection"] else -math.inf
                beyond = tail(v / n["deviation"]) if n["deviation"] and math.isfinite(v) else 0.0
                left = 1 - beyond if v <= 0 else beyond
                part = float(rng.binomial(int(share), left)) if rng is not None else share * left
                for side, s in (("left", part), ("right", share - part)):
                    if s > 0:
                        if n[f"{side}_node"] is not None:
                            stack.append((n[f"{side}_node"], s))
                        else:
                            word = n[f"{side}_word"]
                            total[word] = total.get(word, 0.0) + s
        return [{"word": w, "weight": s / (slots * max(1, len(trees)))} for w, s in sorted(total.items())]

    def run(batches):
        for batch in batches:
            out = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                out.append(None if v is None else weights(np.asarray(v, np.float64), None if seed is None else np.random.default_rng([seed, hash(k) & 0xFFFFFFFF])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.struct([("word", pa.int32()), ("weight", pa.float64())])))], [*batch.schema.names, "word_weights"])

    return rows.mapInArrow(run, rows.withColumn("word_weights", F.expr("cast(null as array<struct<word:int,weight:double>>)")).schema)

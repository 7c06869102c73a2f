"""The k most similar vectors of every vector, by cosine.

A forest of random-projection trees is fitted on a bounded sample and indexes every row. A query walks all
trees through one shared priority queue ordered by the smallest margin on the path, takes the best leaves,
and the members of those leaves are reranked exactly.

The queue is run for a block of rows at once, best first: each step pops every row's best open node, walks down to
its leaf on the near side and pushes the far sides it passes. A near child keeps the priority of the node popped, so
the leaves come out in exactly the order of one queue a row. Margins of the upper levels come from one matrix
product, deeper ones are worked out only where a walk comes by: work a row grows with visits x depth.

Bounds and scale. The sample has at most ``MAX_SAMPLE`` rows a space, so what the tasks receive does not grow with
the data. A leaf's members are cut into parts of at most ``PART_MEMBERS`` and its queries into as many, so no group
is larger, however popular the leaf; where the sample no longer allows leaves of ``leaf_rows``, a part is searched
through a tree of its own. Pairs of a least cosine are first sought on vectors of one byte a number: the rounding
error of each vector is known, the limit is lowered by it, so nothing is lost, and only the pairs left are compared
in full.

Cases. Null vectors, vectors with a null or NaN element, and all-zero vectors are dead: they are neither
queries nor neighbours. Rows with a null space or id are left out. Repeated rows count once; if one key has
several different vectors the smallest counts. Vectors of different lengths never neighbour each other.
Entities with the same direction form one class, searched once and expanded afterwards, so a
group of copies cannot fill a leaf. Equal cosines are ordered by id. Empty input gives empty output. Columns
other than the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.skew import against_all, expand_pairs, salted_join
from tracklake.session import checkpointed

MIN_SAMPLE, MAX_SAMPLE, SAMPLE_PER_LEAF = 16_384, 262_144, 32
#: Rows that one step of routing or reranking holds as a matrix.
STEP = 2048
#: Levels of a tree whose margins are worked out for all rows at once.
TOP_LEVELS = 8
#: Members of a leaf in one group.
PART_MEMBERS = 20_000
#: Bytes of identifiers that may be sent to every task.
SENT_BYTES = 32_000_000


@dataclass
class Forest:
    """The trees of one (space, length): hyperplanes in heap order, all trees below one another."""

    trees: int
    depth: int
    planes: np.ndarray
    cuts: np.ndarray

    @property
    def leaves(self) -> int:
        return 2**self.depth

    @property
    def inner(self) -> int:
        return self.leaves - 1

    def _margins(self, rows: np.ndarray) -> np.ndarray:
        """Margins of the upper levels of all trees, [row, tree * top + node]."""
        top = 2 ** min(self.depth, TOP_LEVELS) - 1
        at = (np.arange(self.trees)[:, None] * self.inner + np.arange(top)).ravel()
        return rows @ self.planes[at].T - self.cuts[at]

    def _margin(self, rows: np.ndarray, upper: np.ndarray, row: np.ndarray, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Margins of single nodes: looked up in the upper levels, worked out below them."""
        top = 2 ** min(self.depth, TOP_LEVELS) - 1
        out = upper[row, tree * top + np.minimum(node, top - 1)]
        deep = np.flatnonzero(node >= top)
        if len(deep):
            at = tree[deep] * self.inner + node[deep]
            out[deep] = np.einsum("rd,rd->r", rows[row[deep]], self.planes[at]) - self.cuts[at]
        return out

    def best_leaves(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """[row, visit]: the leaves (tree * leaves + leaf) that the shared queue yields first, best first."""
        visits = min(visits, self.trees * self.leaves)
        n = len(rows)
        if self.depth == 0:
            return np.zeros((n, visits), np.int64)
        upper, every = self._margins(rows), np.arange(n)
        # The open nodes of every row, with room for all that can be pushed.
        priority = np.full((n, self.trees + visits * self.depth), -np.inf, np.float32)
        tree, node = np.zeros(priority.shape, np.int16), np.zeros(priority.shape, np.int64)
        priority[:, : self.trees], tree[:, : self.trees] = np.inf, np.arange(self.trees)
        out = np.empty((n, visits), np.int64)
        for v in range(visits):
            best = priority.argmax(1)
            p, t, x = priority[every, best], tree[every, best].astype(np.int64), node[every, best].copy()
            priority[every, best] = -np.inf
            for level in range(self.depth):
                going = np.flatnonzero(x < self.inner)
                if not len(going):
                    break
                m = self._margin(rows, upper, going, t[going], x[going])
                far = self.trees + v * self.depth + level
                right = m > 0
                priority[going, far] = np.minimum(p[going], -np.abs(m))
                tree[going, far], node[going, far] = t[going], 2 * x[going] + np.where(right, 1, 2)
                x[going] = 2 * x[going] + np.where(right, 2, 1)
            out[:, v] = t * self.leaves + x - self.inner
        return out

    def own_leaves(self, rows: np.ndarray) -> np.ndarray:
        """[row, tree]: the leaf of each tree that a row lies in, as tree * leaves + leaf."""
        upper, every = self._margins(rows) if self.depth else None, np.arange(len(rows))
        out = np.zeros((len(rows), self.trees), np.int64)
        for t in range(self.trees):
            x = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                x = 2 * x + np.where(self._margin(rows, upper, every, np.full(len(rows), t), x) > 0, 2, 1)
            out[:, t] = t * self.leaves + x - self.inner
        return out


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    """Each node splits in the middle of its sample along the line between two of its means."""
    rng = np.random.default_rng(seed)
    if depth == 0:
        return Forest(1, 0, np.zeros((0, sample.shape[1]), np.float32), np.zeros(0, np.float32))
    inner = 2**depth - 1
    planes = np.zeros((trees * inner, sample.shape[1]), np.float32)
    cuts = np.zeros(trees * inner, np.float32)
    for t in range(trees):
        parts = [np.arange(len(sample))]
        for node in range(inner):
            at = parts[node]
            rows = sample[at]
            line = rng.standard_normal(sample.shape[1]).astype(np.float32)
            if len(at) >= 2:
                a, b = rows[rng.choice(len(at), 2, replace=False)]
                for _ in range(3):
                    near = rows @ (a - b) > 0
                    if near.all() or not near.any():
                        break
                    a, b = rows[near].mean(0), rows[~near].mean(0)
                    a, b = a / max(np.linalg.norm(a), 1e-12), b / max(np.linalg.norm(b), 1e-12)
                if np.linalg.norm(a - b) > 1e-6:
                    line = a - b
            line /= np.linalg.norm(line)
            along = rows @ line
            middle = np.sort(along)[max(0, len(at) // 2 - 1) : len(at) // 2 + 1]
            cut = np.float32(middle.mean()) if len(at) else np.float32(0)  # between two rows, so none lies on it
            planes[t * inner + node], cuts[t * inner + node] = line, cut
            right = along > cut
            parts += [at[~right], at[right]]
    return Forest(trees, depth, planes, cuts)


def _unit(values: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.float32).reshape(len(values), dim)


def live_vectors(df: DataFrame, space: str = "space", ident: str = "entity_id", vector: str = "v") -> DataFrame:
    """(space, dim, id, unit): one row per live entity, ``unit`` the normalised vector as packed float32."""
    sound = df.select(F.col(space).alias("space"), F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("space").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull()
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units: list[bytes | None] = []
            dims: list[int] = []
            for v in batch.column(2):
                x = v.values.to_numpy(zero_copy_only=False) if v.values is not None else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                ok = len(x) > 0 and np.isfinite(top) and top > 0
                x = x / top if ok else x
                units.append((x / np.linalg.norm(x)).astype(np.float32).tobytes() if ok else None)
                dims.append(len(x))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), batch.column(1), pa.array(units, pa.binary())], names=["space", "dim", "id", "unit"])
            yield out.filter(out.column(3).is_valid())

    packed = sound.mapInArrow(pack, "space string, dim int, id long, unit binary")
    return packed.groupBy("space", "id").agg(F.min(F.struct("unit", "dim")).alias("u")).select("space", F.col("u.dim").alias("dim"), "id", F.col("u.unit").alias("unit"))


@dataclass
class Index:
    """Classes of equal direction with their members, and a fitted forest for each (space, dim)."""

    classes: DataFrame  # space, dim, id (smallest member), n, unit
    members: DataFrame  # space, rep, id: members of classes of more than one
    forests: dict[tuple[str, int], Forest]
    leaf_rows: int = 1000


def build_index(df: DataFrame, space: str = "space", ident: str = "entity_id", vector: str = "v", trees: int = 4, leaf_rows: int = 1000, seed: int = 7) -> Index:
    """Index of all live rows. The collected sample is at most MAX_SAMPLE rows a space, chosen by hash."""
    live = checkpointed(live_vectors(df, space, ident, vector))
    classes = checkpointed(live.groupBy("space", "dim", "unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    several = classes.where("n > 1").select("space", "dim", "unit", F.col("id").alias("rep"))
    members = checkpointed(salted_join(live, several, ["space", "dim", "unit"], [F.col("id")]).select("space", "rep", "id"))
    sizes = {(r.space, r.dim): r.c for r in classes.groupBy("space", "dim").agg(F.count(F.lit(1)).alias("c")).collect()}
    want = {k: min(MAX_SAMPLE, max(MIN_SAMPLE, SAMPLE_PER_LEAF * n // leaf_rows)) for k, n in sizes.items()}
    forests = {}
    for (name, dim), n in sizes.items():
        depth = max(0, min(int(np.ceil(np.log2(n / leaf_rows))), int(np.log2(want[name, dim] / SAMPLE_PER_LEAF)))) if n > leaf_rows else 0
        sample = np.zeros((0, dim), np.float32)
        if depth:
            keep = int(1e6 * want[name, dim] / n)
            got = classes.where((F.col("space") == name) & (F.col("dim") == dim) & (F.pmod(F.xxhash64("space", "id"), F.lit(1_000_000)) < keep)).select("id", "unit").toArrow()
            order = np.argsort(got["id"].to_numpy())
            sample = _unit(got["unit"], dim)[order]
        forests[name, dim] = fit_forest(sample, trees, depth, seed)
    return Index(classes, members, forests, leaf_rows)


def _rounded(unit: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(one byte a number behind its scale, error) of unit vectors; the error is the length of what rounding takes away."""
    scale = np.maximum(np.abs(unit).max(1), 1e-12).astype(np.float32) / np.float32(127)
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit.astype(np.float64) - code * scale[:, None].astype(np.float64), axis=1)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, code, strict=True)], error


def _opened(values: pa.Array, dim: int) -> np.ndarray:
    """The vectors of ``_rounded``."""
    raw = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(len(values), dim + 4)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


ROUTED = "space string, dim int, leaf int, id long, vector binary, error float, is_member boolean, is_query boolean"


def _routed(index: Index, queries: Column | None, visits: int, rounded: bool) -> DataFrame:
    """ROUTED: every class in its own leaves, every query in its best; vectors rounded or whole."""
    sent = index.classes.sparkSession.sparkContext.broadcast(index.forests)
    rows = index.classes.select("space", "dim", "id", "unit", (queries if queries is not None else F.lit(True)).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, dims = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            ask = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            for name, dim in set(zip(names.tolist(), dims.tolist(), strict=True)):
                forest = sent.value[name, dim]
                every = np.flatnonzero((names == name) & (dims == dim))
                for a in range(0, len(every), STEP):
                    at = every[a : a + STEP]
                    unit = _unit(batch.column(3).take(pa.array(at)), dim)
                    own = forest.own_leaves(unit)
                    row, leaf = np.repeat(np.arange(len(at)), forest.trees), own.ravel()
                    member, query = np.ones(len(row), bool), np.zeros(len(row), bool)
                    asks = np.flatnonzero(ask[at])
                    if len(asks):
                        best = forest.best_leaves(unit[asks], visits)
                        total = forest.trees * forest.leaves
                        code = np.repeat(asks, best.shape[1]) * np.int64(total) + best.ravel()
                        mine = row * np.int64(total) + leaf
                        query = np.isin(mine, code)
                        extra = np.setdiff1d(code, mine)
                        row, leaf = np.append(row, extra // total), np.append(leaf, extra % total)
                        member, query = np.append(member, np.zeros(len(extra), bool)), np.append(query, np.ones(len(extra), bool))
                    if rounded:
                        packed, error = _rounded(unit)
                        vector = pa.array(packed, pa.binary()).take(pa.array(row))
                    else:
                        vector, error = batch.column(3).take(pa.array(at[row])), np.zeros(len(at))
                    take = pa.array(at[row])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(leaf, pa.int32()), batch.column(2).take(take), vector, pa.array(error[row].astype(np.float32)), pa.array(member), pa.array(query)],
                        names=["space", "dim", "leaf", "id", "vector", "error", "is_member", "is_query"],
                    )

    return rows.mapInArrow(run, ROUTED)


def _leaf_sizes(index: Index) -> DataFrame:
    """(space, dim, leaf, parts): leaves of more than PART_MEMBERS members, and the parts they need; at most as many rows as there are leaves."""
    sent = index.classes.sparkSession.sparkContext.broadcast(index.forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, dims = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            for name, dim in set(zip(names.tolist(), dims.tolist(), strict=True)):
                at = np.flatnonzero((names == name) & (dims == dim))
                leaf, n = np.unique(sent.value[name, dim].own_leaves(_unit(batch.column(2).take(pa.array(at)), dim)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(leaf), pa.string()), pa.array(np.full(len(leaf), dim), pa.int32()), pa.array(leaf, pa.int32()), pa.array(n, pa.int64())], names=["space", "dim", "leaf", "n"])

    counted = index.classes.select("space", "dim", "unit").mapInArrow(run, "space string, dim int, leaf int, n long").groupBy("space", "dim", "leaf").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") > PART_MEMBERS).select("space", "dim", "leaf", F.ceil(F.col("n") / PART_MEMBERS).cast("int").alias("parts"))


KEYS = ["space", "dim", "leaf", "part", "side"]


def _grouped(index: Index, queries: Column | None, visits: int, rounded: bool):
    """Routed rows by (leaf, part of its members, part of its queries): a group has some PART_MEMBERS of each at most.

    Only leaves that are over it are cut; those are few enough to be sent to every task (see ``_leaf_sizes``).
    """
    routed = _routed(index, queries, visits, rounded)
    largest = max((f.leaves * f.trees for f in index.forests.values()), default=0)
    big = _leaf_sizes(index).collect() if largest else []
    if not big:
        return routed.withColumns({"part": F.lit(0), "side": F.lit(0)}).groupBy(*KEYS)
    sizes = index.classes.sparkSession.createDataFrame(big, "space string, dim int, leaf int, parts int")
    cut = routed.join(F.broadcast(sizes), ["space", "dim", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    # A member meets every part of the queries, a query every part of the members.
    as_member = cut.where("is_member").withColumn("part", own).withColumn("side", F.explode(each)).withColumn("is_query", F.lit(False))
    as_query = cut.where("is_query").withColumn("side", own).withColumn("part", F.explode(each)).withColumn("is_member", F.lit(False))
    return as_member.unionByName(as_query).drop("parts").groupBy(*KEYS)


def _blocks(table: pa.Table, rounded: bool, leaf_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, member places, cosines) within one group, some queries at a time; a large group through a tree of its own."""
    dim = table["dim"][0].as_py()
    vectors = table["vector"].combine_chunks()
    unit = _opened(vectors, dim) if rounded else _unit(vectors, dim)
    m = np.flatnonzero(table["is_member"].to_numpy(zero_copy_only=False))
    q = np.flatnonzero(table["is_query"].to_numpy(zero_copy_only=False))
    pairs = [(q, m)]
    if len(m) > 4 * leaf_rows:
        # Sixteen leaves of leaf_rows, or half of all of them, out of four trees.
        depth = int(np.ceil(np.log2(len(m) / leaf_rows)))
        pick = np.random.default_rng(len(m)).permutation(m)[: SAMPLE_PER_LEAF * 2**depth]
        forest = fit_forest(unit[np.sort(pick)], 4, depth, 7)
        own = forest.own_leaves(unit[m]).ravel()
        asked = forest.best_leaves(unit[q], max(16, 2 * forest.leaves))
        mo, qo = np.argsort(own, kind="stable"), np.argsort(asked.ravel(), kind="stable")
        bounds = np.arange(forest.trees * forest.leaves + 1)
        me, qe = np.searchsorted(own[mo], bounds), np.searchsorted(asked.ravel()[qo], bounds)
        pairs = [(q[qo[qe[i] : qe[i + 1]] // asked.shape[1]], m[mo[me[i] : me[i + 1]] // forest.trees]) for i in range(len(bounds) - 1)]
    for q, m in pairs:
        step = max(1, min(STEP, 16_000_000 // max(1, len(m))))
        for a in range(0, len(q) if len(m) else 0, step):
            part = q[a : a + step]
            yield part, m, unit[part] @ unit[m].T


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double, the same for a pair whatever leaf it is met in."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(1).round(6)


def _class_links(index: Index, min_cosine: float, visits: int) -> DataFrame:
    """(space, label_a, label_b): classes of cosine at least ``min_cosine``, each pair once, no cap.

    Each leaf lists the pairs that rounding cannot exclude, smaller class first and once; these are compared whole.
    """
    leaf_rows = index.leaf_rows

    def leaf(table: pa.Table) -> pa.Table:
        ids, error = table["id"].to_numpy(), table["error"].to_numpy().astype(np.float64)
        dim = table["dim"][0].as_py()
        found = []
        for q, m, cos in _blocks(table, True, leaf_rows):
            # The limit falls by at most both errors, their product, and the last bits of the product of matrices:
            # first by the largest errors there are, then, for what is left, by those of the pair.
            most = error.max()
            r, c = np.divmod(np.flatnonzero(cos.ravel() >= np.float32(min_cosine - most * (2 + most) - 2e-5)), cos.shape[1])
            e, f = error[q[r]], error[m[c]]
            close = cos[r, c] >= min_cosine - (e * (1 + f) + f + 1e-5)
            a, b = ids[q[r[close]]], ids[m[c[close]]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b])
        got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"space": pa.repeat(table["space"][0], len(got)).cast(pa.string()), "dim": pa.array(np.full(len(got), dim), pa.int32()), "label_a": pa.array(got[:, 0], pa.int64()), "label_b": pa.array(got[:, 1], pa.int64())})

    maybe = checkpointed(_grouped(index, None, visits, True).applyInArrow(leaf, "space string, dim int, label_a long, label_b long").distinct())
    ends = checkpointed(maybe.select("space", "dim", F.col("label_a").alias("id")).union(maybe.select("space", "dim", F.col("label_b").alias("id"))).distinct())
    units = index.classes.select("space", "dim", "id", "unit")
    # Few ends go to the vectors, so the vectors stay where they are; many are joined.
    units = units.join(F.broadcast(ends) if ends.count() * 48 <= SENT_BYTES else ends, ["space", "dim", "id"], "left_semi")
    a, b = (units.select("space", "dim", F.col("id").alias(f"label_{x}"), F.col("unit").alias(f"unit_{x}")) for x in "ab")
    both = salted_join(salted_join(maybe, a, ["space", "dim", "label_a"], [F.col("label_b")]), b, ["space", "dim", "label_b"], [F.col("label_a")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keep = batch.column(3).to_numpy(), np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                take = pa.array(at)
                keep[at] = _exact(_unit(batch.column(4).take(take), int(dim)), _unit(batch.column(5).take(take), int(dim))) >= min_cosine
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["space", "label_a", "label_b"]).filter(pa.array(keep))

    return both.select("space", "label_a", "label_b", "dim", "unit_a", "unit_b").mapInArrow(compare, "space string, label_a long, label_b long")


def similar_pairs(index: Index, min_cosine: float = 0.9, visits: int = 8) -> DataFrame:
    """(space, id_a, id_b): all pairs of live entities found at a cosine of at least ``min_cosine``, id_a < id_b.

    No cap on partners. Members of one class (same direction) pair with each other and share their class's links.
    """
    links = checkpointed(_class_links(index, min_cosine, visits))
    reps = index.classes.where("n > 1").select("space", F.col("id").alias("rep"))
    # Only classes that take part in a link, or have several members, are expanded.
    linked = links.select("space", F.col("label_a").alias("rep")).union(links.select("space", F.col("label_b").alias("rep"))).distinct()
    single = linked.join(reps, ["space", "rep"], "left_anti").select("space", "rep", F.col("rep").alias("id"))
    own = reps.select("space", F.col("rep").alias("label_a"), F.col("rep").alias("label_b"))
    return expand_pairs(index.members.unionByName(single), links.unionByName(own), ["space"], "rep", "id")


def nearest(index: Index, k: int = 10, visits: int = 64, queries: Column | None = None) -> DataFrame:
    """(space, entity_id, rank, neighbour_id, cosine): the ``k`` most similar other entities of each query.

    ``queries`` is a condition on ``id`` choosing query entities (None: every live entity); the collection
    searched is always whole. Rank counts from 1 by cosine, then by id.
    """
    # A class is asked when any member is; the members asked come back in the expansion.
    asked = queries if queries is not None else F.lit(True)
    class_query = index.classes.where(F.col("n") == 1).where(asked).select("space", "id").unionByName(index.members.where(asked).select("space", F.col("rep").alias("id")).distinct())
    flagged = index.classes.join(class_query.withColumn("__q", F.lit(True)), ["space", "id"], "left")
    ready = Index(checkpointed(flagged), index.members, index.forests)

    leaf_rows = index.leaf_rows

    def leaf(table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        ids, unit = table["id"].to_numpy(), _unit(table["vector"].combine_chunks(), table["dim"][0].as_py())
        for q, m, cos in _blocks(table, False, leaf_rows):
            cos[ids[q][:, None] == ids[m][None, :]] = -2
            top = min(k, len(m))
            c = np.argpartition(-cos, top - 1, axis=1)[:, :top] if top < len(m) else np.broadcast_to(np.arange(len(m)), (len(q), len(m)))
            r = np.repeat(np.arange(len(q)), c.shape[1])
            c = c.ravel()
            keep = ids[q[r]] != ids[m[c]]
            r, c = r[keep], c[keep]
            for o, x in zip(out, (ids[q[r]], ids[m[c]], _exact(unit[q[r]], unit[m[c]])), strict=True):
                o.append(x)
        a, b, e = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return _listed(table["space"][0], a, b, e, k)

    # Entities, not classes, fill a list: k classes always hold the k nearest entities outside the own class.
    found = _grouped(ready, F.col("__q").isNotNull(), visits, False).applyInArrow(leaf, "space string, rep long, near array<struct<minus:double,id:long>>")
    return _expanded(index, found, k, asked)


def _listed(space: pa.Scalar, a: np.ndarray, b: np.ndarray, e: np.ndarray, k: int) -> pa.Table:
    """(space, rep, near): the best ``k`` of each query of a group."""
    order = np.lexsort((b, -e, a))
    a, b, e = a[order], b[order], e[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    a, b, e = a[fresh], b[fresh], e[fresh]
    ids, first, n = np.unique(a, return_index=True, return_counts=True)
    best = (np.arange(len(a)) - np.repeat(first, n)) < k
    offsets = pa.array(np.append(0, np.cumsum(np.minimum(n, k))), pa.int32())
    near = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(-e[best], pa.float64()), pa.array(b[best], pa.int64())], names=["minus", "id"]))
    return pa.table({"space": pa.repeat(space, len(ids)).cast(pa.string()), "rep": pa.array(ids, pa.int64()), "near": near})


def _expanded(index: Index, found: DataFrame, k: int, asked: Column) -> DataFrame:
    """(space, entity_id, rank, neighbour_id, cosine) from lists of classes (space, rep, near)."""
    lists = found.groupBy("space", "rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    near = lists.select("space", "rep", F.explode("near").alias("x")).select("space", "rep", F.col("x.id").alias("other"), (-F.col("x.minus")).alias("cosine"))
    # At most k + 1 members of a class can appear in any list; the limit is applied before the shuffle.
    front = index.members.withColumn("r", F.row_number().over(Window.partitionBy("space", "rep").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    own = salted_join(index.members.where(asked).select("space", "rep", F.col("id").alias("entity_id")), front.withColumnRenamed("id", "neighbour_id"), ["space", "rep"], [F.col("entity_id")]).where("entity_id <> neighbour_id").select("space", "entity_id", "neighbour_id", F.lit(1.0).alias("cosine"))
    # Neighbour classes become neighbour entities, then the query class becomes its asked members.
    sized = near.join(index.classes.select("space", F.col("id").alias("other"), F.col("n").alias("on")), ["space", "other"])
    plain = sized.where("on = 1").select("space", "rep", F.col("other").alias("neighbour_id"), "cosine")
    grouped = sized.where("on > 1").join(front.select("space", F.col("rep").alias("other"), F.col("id").alias("neighbour_id")), ["space", "other"]).select("space", "rep", "neighbour_id", "cosine")
    per_class = plain.unionByName(grouped)
    lone = index.classes.where("n = 1").where(asked).select("space", F.col("id").alias("rep"), F.col("id").alias("entity_id"))
    many = index.members.where(asked).select("space", "rep", F.col("id").alias("entity_id"))
    asked_members = lone.unionByName(many)
    others = salted_join(asked_members, per_class, ["space", "rep"], [F.col("entity_id")]).select("space", "entity_id", "neighbour_id", "cosine")
    by = Window.partitionBy("space", "entity_id").orderBy(F.desc("cosine"), "neighbour_id")
    return others.unionByName(own).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("space", "entity_id", "rank", "neighbour_id", "cosine")


def nearest_exact(index: Index, k: int, queries: Column) -> DataFrame:
    """Brute force for a stated query set against all rows, in blocks: entities as ``nearest`` gives them, for measuring it."""
    reps = index.classes.where("n = 1").where(queries).select("space", "id").unionByName(index.members.where(queries).select("space", F.col("rep").alias("id")).distinct())
    asked = checkpointed(index.classes.select("space", "dim", "id", "unit").join(reps, ["space", "id"], "left_semi"))

    def run(q: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = np.array([f"{d}\0{s}" for s, d in zip(q["space"].to_pylist(), q["dim"].to_pylist(), strict=True)], object)
        for batch in batches:
            there = np.array([f"{d}\0{s}" for s, d in zip(batch.column("space").to_pylist(), batch.column("dim").to_pylist(), strict=True)], object)
            for g in sorted(set(there.tolist()) & set(group.tolist())):
                dim, _, space = g.partition("\0")
                mine, rows = np.flatnonzero(group == g), np.flatnonzero(there == g)
                qi, qu = q["id"].to_numpy()[mine], _unit(q["unit"].take(pa.array(mine)).combine_chunks(), int(dim))
                mi, mu = batch.column("id").to_numpy()[rows], _unit(batch.column("unit").take(pa.array(rows)), int(dim))
                for a in range(0, len(qi), STEP):
                    cos = qu[a : a + STEP] @ mu.T
                    cos[qi[a : a + STEP, None] == mi[None, :]] = -2
                    c = np.argpartition(-cos, min(k, len(mi)) - 1, axis=1)[:, :k]
                    r = np.repeat(np.arange(len(cos)), c.shape[1])
                    c = c.ravel()
                    r, c = r[qi[a + r] != mi[c]], c[qi[a + r] != mi[c]]
                    out = _listed(pa.scalar(space), qi[a + r], mi[c], _exact(qu[a + r], mu[c]), k)
                    yield from out.cast(pa.schema([("space", pa.string()), ("rep", pa.int64()), ("near", out.schema.field("near").type)])).to_batches()

    found = against_all(asked, index.classes.select("space", "dim", "id", "unit"), run, "space string, rep long, near array<struct<minus:double,id:long>>", F.length("unit") + F.length("space") + 48)
    return _expanded(index, found, k, queries)

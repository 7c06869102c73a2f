"""How often two items occur in the same basket, and how surprising that is.

Items are numbered in the order of their frequency, so the frequency of a number is read from the histogram of
frequencies, and a pair carries nothing but its two numbers.

Counting. Items fall into groups, and every pair of groups is one task, sized so that its distinct pairs fit. A
basket sends each task only its items of the two groups, packed, a batch of baskets to a row; pairs come into being
and are added up where they are counted, and are never shuffled. The copies of an item grow with the number of
groups. Where they would outweigh the pairs themselves (very many pairs of short baskets), each task instead turns
its baskets into packed pair codes, adds up equal codes and shuffles those by hash. Both ways give the same counts.
Every pair that can pass is counted exactly. What cannot is left out before it is enumerated: items in fewer
than ``min_count`` baskets, and pairs whose frequencies allow no NPMI of ``min_npmi`` even if the rarer item never
occurs without the other (one comparison of logarithms).

Null model. A bipartite configuration model keeps, in expectation, the frequency of every item and the size of
every basket: item i is in basket b with probability x_i y_b / (1 + x_i y_b). The fugacities depend on the
degrees only. They are fitted on the degree histograms, large degrees in bins of one per cent; then every frequency
that occurs gets its own fugacity from its own equation. Under the model the number of baskets that hold both items
is Poisson-binomial (over the basket sizes, those above DEGREE_BINS in bins of one per cent); its upper tail is
summed exactly, once per distinct (frequency, frequency, count) of a task. Benjamini-Hochberg over all pairs of
items controls the false-discovery rate; pairs left out beforehand count as not significant, which only makes it
stricter.

Cases. A null or empty list is no basket. Repeated rows count once; of different lists of one basket the union
counts. An item repeated in a basket counts once; null items and null baskets are left out. Items must be
integers below 2^31. An empty table gives no pairs.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.skew import salted_join
from tracklake.session import checkpointed

CHUNK = 1024
BLOCK_PAIRS = 4_000_000
PAIRS_PER_TASK = 4_000_000
#: Degrees up to this count each, larger ones in bins of one per cent: at most some thousands of classes.
DEGREE_BINS = 2048
TAIL_TERMS = 40
#: Bytes of item numbers that are sent to every task; more are looked up by joins.
NUMBER_BYTES = 64_000_000


def baskets(df: DataFrame, basket: str, items: str) -> DataFrame:
    """(basket, items): one row per basket with its distinct items in ascending order."""
    sound = df.select(F.col(basket).alias("basket"), F.array_compact(F.col(items).cast("array<int>")).alias("items")).where("basket IS NOT NULL AND size(items) > 0")
    return sound.groupBy("basket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


@dataclass
class Reach:
    """Which pairs can reach an NPMI: ``log_n`` of the number of each distinct frequency, and the limit by the rarer one."""

    start: np.ndarray  # first item number of each distinct frequency
    log_n: np.ndarray
    limit: np.ndarray  # largest log frequency of a partner

    @classmethod
    def of(cls, degrees: np.ndarray, degree_n: np.ndarray, n_baskets: int, min_npmi: float) -> Reach:
        """From (1 + t) ln n_ab >= ln n_a + ln n_b - (1 - t) ln N with n_ab at most the smaller of n_a and n_b."""
        log_n = np.log(degrees)
        return cls(np.append(0, np.cumsum(degree_n)[:-1]).astype(np.int64), log_n, min_npmi * log_n + (1 - min_npmi) * np.log(max(n_baskets, 1)) + 1e-9)

    def of_items(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.start, items, side="right") - 1
        return self.log_n[at], self.limit[at]


def _codes(lists: pa.Array, reach: Reach | None = None) -> Iterator[np.ndarray]:
    """Packed codes (a << 32 | b, a < b) of all pairs within each sorted list, a block at a time."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy().astype(np.int64)
    log_n, limit = reach.of_items(flat) if reach else (None, None)
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 1]
    at = 0
    while at < len(order):
        n = int(sizes[order[at]])
        same = int(np.searchsorted(sizes[order], n, side="right")) - at
        a, b = np.triu_indices(n, 1)
        step = max(1, BLOCK_PAIRS // len(a))
        for lo in range(at, at + same, step):
            rows = offsets[order[lo : min(lo + step, at + same)], None] + np.arange(n)
            if reach:
                row, pair = np.nonzero(log_n[rows][:, b] <= limit[rows][:, a])
                yield (flat[rows[row, a[pair]]] << 32) | flat[rows[row, b[pair]]]
            else:
                items = flat[rows]
                yield ((items[:, a] << 32) | items[:, b]).ravel()
        at += same


def _cross_codes(left: pa.Array, right: pa.Array, reach: Reach | None = None) -> Iterator[np.ndarray]:
    """Packed codes of all pairs between two disjoint lists of a row, all of the first before all of the second."""
    for x, y in zip(left, right, strict=True):
        a, b = x.values.to_numpy().astype(np.int64), y.values.to_numpy().astype(np.int64)
        if reach:
            i, j = np.nonzero(reach.of_items(b)[0][None, :] <= reach.of_items(a)[1][:, None])
            yield (a[i] << 32) | b[j]
        else:
            yield ((a[:, None] << 32) | b[None, :]).ravel()


def _combined(codes: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n, pa.int64())], names=["code", "n"])

    for c in codes:
        held.append(c)
        size += len(c)
        if size >= BLOCK_PAIRS:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. , one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _packed_blocks(lists: pa.Array, groups: int) -> Iterator[tuple[int, bytes]]:
    """(block, packed lists): for each pair of groups the items of both in every basket that can have a pair.

    Packed are the number of baskets, the sizes of their left and right lists, and their items; a block of one
    group has the same list on both sides and carries it once.
    """
    flat = lists.values.to_numpy().astype(np.int32)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    group = flat % groups
    order = np.lexsort((flat, group, owner))
    flat = flat[order]
    size = np.bincount(owner * groups + group, minlength=len(lists) * groups)
    start = (np.cumsum(size) - size).reshape(-1, groups)
    size = size.reshape(-1, groups)
    block = 0
    for g in range(groups):
        for h in range(g, groups):
            rows = np.flatnonzero((size[:, g] > 0) & (size[:, h] > (1 if g == h else 0)))
            if len(rows):
                sides = [g] if g == h else [g, h]
                parts = [np.array([len(rows)], np.int32), *(size[rows, k].astype(np.int32) for k in sides), *(flat[_ranges(start[rows, k], size[rows, k])] for k in sides)]
                yield block, np.concatenate(parts).tobytes()
            block += 1


def _block_codes(packed: bytes, single: bool, reach: Reach | None) -> Iterator[np.ndarray]:
    """Packed codes of the pairs of one row of ``_packed_blocks``, about BLOCK_PAIRS at a time."""
    data = np.frombuffer(packed, np.int32)
    n = int(data[0])
    left = data[1 : n + 1].astype(np.int64)
    right = left if single else data[n + 1 : 2 * n + 1].astype(np.int64)
    items = data[n + 1 :] if single else data[2 * n + 1 :]
    a_start = np.cumsum(left) - left
    b_start = a_start if single else left.sum() + np.cumsum(right) - right
    # A list too long to be met whole is cut on its left side.
    most = np.maximum(1, BLOCK_PAIRS // np.maximum(right, 1))
    cuts = -(-left // most)
    row = np.repeat(np.arange(n), cuts)
    skip = _ranges(np.zeros(n, np.int64), cuts) * most[row]
    a_size, a_start = np.minimum(most[row], left[row] - skip), a_start[row] + skip
    b_size, b_start = right[row], b_start[row]
    ends = np.cumsum(a_size * b_size)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_PAIRS, side="right")))
        each = _ranges(np.zeros(hi - lo, np.int64), (a_size * b_size)[lo:hi])
        at = np.repeat(np.arange(lo, hi), (a_size * b_size)[lo:hi])
        i, j = a_start[at] + each // b_size[at], b_start[at] + each % b_size[at]
        if single:
            i, j = i[i < j], j[i < j]
        x, y = items[i].astype(np.int64), items[j].astype(np.int64)
        x, y = np.minimum(x, y), np.maximum(x, y)
        if reach:
            kept = reach.of_items(y)[0] <= reach.of_items(x)[1]
            x, y = x[kept], y[kept]
        yield (x << 32) | y
        lo = hi


def _merged(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def _counted(bags: DataFrame, finish: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str, reach: Reach | None = None) -> DataFrame:
    """``finish(codes, counts)`` of all pairs of the bags, some hundred thousand distinct codes at a time."""
    sums = bags.agg(F.sum(F.size("items").cast("long") * (F.size("items") - 1) / 2).alias("pairs"), F.sum(F.size("items").cast("long")).alias("entries")).first()
    tasks = max(int(bags.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((sums.pairs or 0) // PAIRS_PER_TASK) + 1)
    groups = int(np.ceil((np.sqrt(8 * tasks + 1) - 1) / 2))
    if 4 * (sums.entries or 0) * groups > 8 * (sums.pairs or 0):
        return _counted_by_code(bags, finish, schema, tasks, reach)
    blocks = [(g, h) for g in range(groups) for h in range(g, groups)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                got = list(_packed_blocks(pa.concat_arrays([batch.column(0).slice(at, 5_000)]), groups))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=["block", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for c in _block_codes(packed.as_buffer(), blocks[block][0] == blocks[block][1], reach):
                    held.append(c)
                    size += len(c)
                    if size >= BLOCK_PAIRS:
                        new, m = np.unique(np.concatenate(held), return_counts=True)
                        code, n = _merged(np.append(code, new), np.append(n, m))
                        held, size = [], 0
        if size:
            new, m = np.unique(np.concatenate(held), return_counts=True)
            code, n = _merged(np.append(code, new), np.append(n, m))
        for a in range(0, len(code), 100_000):
            yield finish(code[a : a + 100_000], n[a : a + 100_000])

    sent = bags.where("size(items) > 1").select("items").mapInArrow(send, "block int, packed binary")
    return sent.repartitionById(len(blocks), "block").mapInArrow(count, schema)


def _counted_by_code(bags: DataFrame, finish: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str, tasks: int, reach: Reach | None) -> DataFrame:
    """The same by shuffled codes, combined within each task first. Baskets longer than CHUNK are cut into chunks, whose pairs are rows of their own."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def codes() -> Iterator[np.ndarray]:
            for batch in batches:
                yield from _codes(pa.concat_arrays([batch.column(0)]), reach)

        yield from _combined(codes())

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def codes() -> Iterator[np.ndarray]:
            for batch in batches:
                yield from _cross_codes(batch.column(0), batch.column(1), reach)

        yield from _combined(codes())

    kind = "code long, n long"
    short = bags.where(F.size("items").between(2, CHUNK)).select("items")
    n_chunks = F.floor((F.size("items") - 1) / CHUNK).cast("int")
    long = bags.where(F.size("items") > CHUNK).select("items", F.explode(F.sequence(F.lit(0), n_chunks)).alias("i"))
    cut = [F.slice("items", F.col(c) * CHUNK + 1, CHUNK) for c in ("i", "j")]
    own = long.select(cut[0].alias("items"))
    crossed = long.where(F.col("i") < n_chunks).select("items", "i", F.explode(F.sequence(F.col("i") + 1, n_chunks)).alias("j")).select(cut[0].alias("left"), cut[1].alias("right")).repartition(tasks)
    parts = short.unionByName(own).mapInArrow(within, kind).unionByName(crossed.mapInArrow(between, kind))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up one task's hash share of the codes: about PAIRS_PER_TASK distinct codes at most."""
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            return _merged(np.concatenate([code, *(h[0] for h in held)]), np.concatenate([n, *(h[1] for h in held)]))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= PAIRS_PER_TASK:
                code, n = merge()
                held, size = [], 0
        code, n = merge()
        for a in range(0, len(code), 100_000):
            yield finish(code[a : a + 100_000], n[a : a + 100_000])

    return parts.repartition(tasks, "code").mapInArrow(summed, schema)


def pair_counts(bags: DataFrame, min_count: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab): exact number of baskets that hold both, item_a < item_b, n_ab >= min_count."""

    def finish(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        code, n = code[n >= min_count], n[n >= min_count]
        return pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["item_a", "item_b", "n_ab"])

    return _counted(bags, finish, "item_a int, item_b int, n_ab long")


@dataclass
class Numbered:
    """Baskets of item numbers, in the order of the items' frequency."""

    bags: DataFrame  # basket, items: numbers from 0, ascending; items below the least frequency left out
    items: DataFrame  # item, number, n
    degrees: np.ndarray  # distinct frequencies, ascending
    degree_n: np.ndarray  # items of each
    sizes: np.ndarray  # distinct basket sizes (large ones binned), with all items
    size_n: np.ndarray
    names: np.ndarray | None  # item of each number, where they are few enough to be sent

    @property
    def n_baskets(self) -> int:
        return int(self.size_n.sum())

    def frequency(self, number: np.ndarray) -> np.ndarray:
        start = np.append(0, np.cumsum(self.degree_n)[:-1])
        return self.degrees[np.searchsorted(start, number, side="right") - 1].astype(np.int64)


def numbered(bags: DataFrame, min_count: int = 1) -> Numbered:
    """Numbers the items of ``bags``: ranges of (frequency, item) in order, each number its place.

    The frequency histogram reaches the driver; N entries have at most sqrt(2 N) distinct frequencies.
    """
    support = bags.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    ordered = checkpointed(support.repartitionByRange("n", "item").sortWithinPartitions("n", "item")).withColumn("part", F.spark_partition_id())
    counted = {r.part: r.m for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("m")).collect()}
    begin, at = {}, 0
    for part in sorted(counted):
        begin[part], at = at, at + counted[part]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if batch.num_rows:
                first = begin[batch.column(2)[0].as_py()] + done
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(first, first + batch.num_rows), pa.int32()), batch.column(1)], names=["item", "number", "n"])

    items = ordered.mapInArrow(place, "item int, number int, n long")
    got = ordered.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy("n").collect()
    degrees, degree_n = np.array([r.n for r in got], np.int64), np.array([r.m for r in got], np.int64)
    size = F.size("items").cast("long")
    binned = F.when(size <= DEGREE_BINS, size.cast("double")).otherwise(F.floor(F.log(size / F.lit(float(DEGREE_BINS))) / 0.01) + 1e9)
    got = bags.groupBy(binned.alias("b")).agg(F.count(F.lit(1)).alias("m"), F.avg(size).alias("k")).orderBy("b").collect()
    sizes, size_n = np.array([r.k for r in got], np.float64), np.array([r.m for r in got], np.float64)
    least = int(degree_n[degrees < min_count].sum())
    names = None
    if degree_n.sum() * 8 <= NUMBER_BYTES:
        table = items.select("item", "number").toArrow().sort_by("number")
        names = table["item"].to_numpy().astype(np.int32)
        by_item = np.argsort(names, kind="stable").astype(np.int32)
        sent = bags.sparkSession.sparkContext.broadcast((names[by_item], by_item))

        def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, number = sent.value
            for batch in batches:
                lists = pa.concat_arrays([batch.column(0)])
                new = number[np.searchsorted(known, lists.values.to_numpy())] if len(lists.values) else np.zeros(0, np.int32)
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                kept = new >= least
                new, owner = new[kept], owner[kept]
                order = np.lexsort((new, owner))
                offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(lists))))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(new[order], pa.int32()))], names=["items"])

        lists = bags.select("items").mapInArrow(renumber, "items array<int>")
    else:
        each = bags.select("basket", F.explode("items").alias("item"))
        lists = salted_join(each, items.where(F.col("number") >= least).select("item", "number"), ["item"], [F.col("basket")]).groupBy("basket").agg(F.sort_array(F.collect_list("number")).alias("items")).select("items")
    return Numbered(lists, items, degrees, degree_n, sizes, size_n, names)


def measures(num: Numbered, min_count: int = 1, min_npmi: float | None = None, model: NullModel | None = None) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, npmi) of the pairs that reach both limits, and with a model (expected, p_value).

    ``npmi`` = ln(n_ab N / (n_a n_b)) / -ln(n_ab / N); a pair that is in every basket has 1.
    """
    spark = num.bags.sparkSession
    n_baskets, names = num.n_baskets, num.names
    plain = dataclasses.replace(num, bags=None, items=None, names=None)
    reach = Reach.of(num.degrees, num.degree_n, n_baskets, min_npmi) if min_npmi is not None and min_npmi > 0 else None
    sent = spark.sparkContext.broadcast((names, model))
    columns = ["item_a", "item_b", "n_ab", "n_a", "n_b", "npmi", *(["expected", "p_value"] if model is not None else [])]

    def finish(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        names, model = sent.value
        some = n >= min_count
        a, b, n = (code[some] >> 32).astype(np.int32), (code[some] & 0xFFFFFFFF).astype(np.int32), n[some]
        n_a, n_b = plain.frequency(a), plain.frequency(b)
        with np.errstate(divide="ignore", invalid="ignore"):
            npmi = np.where(n == n_baskets, 1.0, np.log(n * float(n_baskets) / (n_a * n_b.astype(np.float64))) / -np.log(n / float(n_baskets)))
        if min_npmi is not None:
            some = npmi >= min_npmi
            a, b, n, n_a, n_b, npmi = (x[some] for x in (a, b, n, n_a, n_b, npmi))
        extra = []
        if model is not None:
            # Numbers are in the order of frequency, so the first is the rarer one.
            keys, place = np.unique(np.stack([n_a, n_b, n], 1), axis=0, return_inverse=True)
            mean, p = np.empty(len(keys)), np.empty(len(keys))
            order = np.argsort(keys[:, 2], kind="stable")
            for at in np.array_split(order, max(1, len(order) // 256)):
                if len(at):
                    mean[at], p[at] = tail(model, keys[at, 0], keys[at, 1], keys[at, 2])
            extra = [pa.array(mean[place.ravel()]), pa.array(p[place.ravel()])]
        if names is not None and len(names):
            a, b = names[a], names[b]
            turned = a > b
            a, b, n_a, n_b = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, n_b, n_a), np.where(turned, n_a, n_b)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(npmi, pa.float64()), *extra], names=columns)

    schema = "item_a int, item_b int, n_ab long, n_a long, n_b long, npmi double" + (", expected double, p_value double" if model is not None else "")
    found = _counted(num.bags, finish, schema, reach)
    if names is not None:
        return found
    a = num.items.select(F.col("number").alias("item_a"), F.col("item").alias("__a"))
    b = num.items.select(F.col("number").alias("item_b"), F.col("item").alias("__b"))
    named = found.join(a, "item_a").join(b, "item_b")
    turned = F.col("__a") > F.col("__b")
    swap = {"item_a": F.least("__a", "__b"), "item_b": F.greatest("__a", "__b"), "n_a": F.when(turned, F.col("n_b")).otherwise(F.col("n_a")), "n_b": F.when(turned, F.col("n_a")).otherwise(F.col("n_b"))}
    return named.select(*[swap.get(c, F.col(c)).alias(c) for c in columns])


def degree_class(n: np.ndarray) -> np.ndarray:
    """Degrees up to DEGREE_BINS as they are, larger ones to the start of their one-per-cent bin."""
    n = np.asarray(n, np.float64)
    big = np.exp(np.floor(np.log(np.maximum(n, 1) / DEGREE_BINS) / 0.01) * 0.01) * DEGREE_BINS
    return np.where(n <= DEGREE_BINS, n, np.round(big))


@dataclass
class NullModel:
    """Fitted fugacities by degree class."""

    item_degree: np.ndarray
    item_x: np.ndarray
    size: np.ndarray
    size_y: np.ndarray
    size_n: np.ndarray

    def chance(self, degree: np.ndarray) -> np.ndarray:
        """[item, size class]: probability that an item of that frequency is in a basket of that size."""
        own, place = np.unique(np.asarray(degree, np.float64), return_inverse=True)
        z = self.fugacity(own)[place.ravel(), None] * self.size_y[None, :]
        return z / (1 + z)

    def fugacity(self, degree: np.ndarray) -> np.ndarray:
        """The x that gives an item exactly its own frequency in expectation: Newton steps on ln x from the fitted classes.

        Frequencies up to DEGREE_BINS are classes of their own, so they are at their solution already.
        """
        x = self.item_x[np.clip(np.searchsorted(self.item_degree, degree_class(degree)), 0, len(self.item_x) - 1)]
        want = np.minimum(degree, self.size_n.sum() - 0.5)
        for _ in range(50):
            z = x[:, None] * self.size_y[None, :]
            p = z / (1 + z)
            got, slope = (self.size_n * p).sum(1), (self.size_n * p * (1 - p)).sum(1)
            step = np.clip((want - got) / np.maximum(slope, 1e-300), -2, 2)
            x = x * np.exp(step)
            if np.abs(step).max(initial=0) < 1e-12:
                break
        return x


def fit_null(degrees: np.ndarray, degree_n: np.ndarray, sizes: np.ndarray, size_n: np.ndarray, rounds: int = 500) -> NullModel:
    """Fixed-point fit of the configuration model to the two degree histograms."""
    d, s = degree_class(degrees), degree_class(sizes)
    kd, ks = np.unique(d), np.unique(s)
    md, ms = (np.array([w[v == k].sum() for k in u], np.float64) for u, v, w in ((kd, d, degree_n), (ks, s, size_n)))
    td, ts = (np.array([(o[v == k] * w[v == k]).sum() for k in u], np.float64) / m for u, v, w, o, m in ((kd, d, degree_n, degrees, md), (ks, s, size_n, sizes, ms)))
    edges = max(1.0, (td * md).sum())
    x, y = td / np.sqrt(edges), ts / np.sqrt(edges)
    # An item in every basket, or a basket of every item, has no finite fugacity: kept just below.
    td, ts = np.minimum(td, ms.sum() - 0.5), np.minimum(ts, md.sum() - 0.5)
    for _ in range(rounds):
        new_x = td / ((ms * y) / (1 + x[:, None] * y[None, :])).sum(1)
        new_y = ts / ((md * new_x) / (1 + y[:, None] * new_x[None, :])).sum(1)
        done = max(np.abs(new_x / x - 1).max(), np.abs(new_y / y - 1).max()) < 1e-10
        x, y = new_x, new_y
        if done:
            break
    return NullModel(kd, x, ks, y, ms)


def tail(model: NullModel, n_a: np.ndarray, n_b: np.ndarray, n_ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected count, P(at least n_ab)) under the Poisson-binomial law of each pair.

    Probabilities of 0, 1, 2 ... successes are built class by class from all-positive products, so small tails keep their
    relative accuracy: above the mean the tail is summed upwards from n_ab, below it is one minus the rest.
    """
    q = np.clip(model.chance(n_a) * model.chance(n_b), 0, 1 - 1e-12)
    m = model.size_n[None, :]
    mean = (q * m).sum(1)
    out = np.ones(len(q))
    for i in range(0, len(q), 256):
        at = slice(i, i + 256)
        out[at] = _tails(q[at], m, mean[at], np.asarray(n_ab[at]))
    return mean, out


def _tails(q: np.ndarray, m: np.ndarray, mean: np.ndarray, k: np.ndarray) -> np.ndarray:
    odds = q / (1 - q)
    top = int(k.max()) + TAIL_TERMS + int(10 * np.sqrt(mean.max()))
    p, scale = np.zeros((len(q), top + 1)), (m * np.log1p(-q)).sum(1)
    steep = odds.max(1) >= 0.4
    gentle = ~steep
    if gentle.any():
        p[gentle], scale[gentle] = _recurrence(odds[gentle], m, scale[gentle], top)
    for i in np.flatnonzero(steep):
        p[i], scale[i] = _convolved(q[i], m[0], top), 0.0
    with np.errstate(over="ignore", under="ignore"):
        up = np.array([row[c:].sum() for row, c in zip(p, k, strict=True)])
        low = np.array([row[:c].sum() for row, c in zip(p, k, strict=True)])
        above = np.exp(np.minimum(scale + np.log(np.maximum(up, 1e-300)), 0))
        below = np.exp(np.minimum(scale + np.log(np.maximum(low, 1e-300)), 0))
    return np.clip(np.where(k > mean, np.where(up > 0, above, 0), 1 - below), 0, 1)


def _recurrence(odds: np.ndarray, m: np.ndarray, scale: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """t P(t) = sum over i of (-1)^(i-1) S_i P(t-i), S_i the power sums of the odds, which fall off as max(odds)^i."""
    worst = max(odds.max(), 1e-18)
    terms = min(top, max(4, int(np.ceil(np.log(1e-18) / np.log(worst))) + 1))
    sums = np.stack([(m * odds**i).sum(1) * (-1) ** (i - 1) for i in range(1, terms + 1)], 1)
    p, scale = np.zeros((len(odds), top + 1)), scale.copy()
    p[:, 0] = 1.0
    for t in range(1, top + 1):
        back = min(t, terms)
        p[:, t] = np.maximum((sums[:, :back] * p[:, t - back : t][:, ::-1]).sum(1) / t, 0)
        big = p[:, t] > 1e200
        if big.any():
            p[big, : t + 1] *= 1e-200
            scale[big] += 200 * np.log(10)
    return p, scale


def _convolved(q: np.ndarray, m: np.ndarray, top: int) -> np.ndarray:
    """The law as a product of the binomials of the size classes, cut after ``top``; for odds too large for the recurrence."""
    p = np.zeros(top + 1)
    p[0] = 1.0
    for a, n in zip(q, m, strict=True):
        if a <= 0 or n <= 0:
            continue
        x = np.arange(1, min(int(n), top) + 1)
        steps = np.log((n - x + 1) / x) + np.log(a / (1 - a))
        law = np.exp(n * np.log1p(-a) + np.append(0.0, np.cumsum(steps)))
        p = np.convolve(p, law)[: top + 1]
    return p


def surprise(bags: DataFrame, min_count: int = 5, alpha: float = 0.01, min_npmi: float | None = None) -> DataFrame:
    """Pairs in at least ``min_count`` baskets: (item_a, item_b, n_ab, n_a, n_b, n_baskets, npmi, expected, p_value, significant).

    With ``min_npmi`` only pairs that reach it. ``significant`` is Benjamini-Hochberg at ``alpha`` over all pairs of
    items, on tails rounded up to 0.01 of a decade.
    """
    bags = checkpointed(bags)
    num = numbered(bags, min_count)
    n_baskets, n_items = num.n_baskets, int(num.degree_n.sum())
    model = fit_null(num.degrees.astype(np.float64), num.degree_n.astype(np.float64), num.sizes, num.size_n) if n_baskets else NullModel(*[np.zeros(0)] * 5)
    judged = checkpointed(measures(num, min_count, min_npmi, model))
    # Bounded histogram of -log10 p in hundredths, up to 300: at most 30,001 rows.
    level = F.when(F.col("p_value") <= 1e-300, F.lit(30_000)).otherwise(F.floor(-F.log10("p_value") * 100)).cast("int")
    bins = {r.b: r.n for r in judged.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tests, seen, cut = n_items * (n_items - 1) / 2, 0, None
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        if 10 ** (-b / 100) * tests / seen <= alpha:
            cut = b
    significant = (level >= cut) if cut is not None else F.lit(False)
    return judged.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"), "npmi", F.round("expected", 6).alias("expected"), "p_value", significant.alias("significant"))


def associations(bags: DataFrame) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, npmi) of every pair of items that ever occur together."""
    return measures(numbered(checkpointed(bags)))

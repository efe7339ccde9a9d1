"""Operator 3: embedding near-dedup by an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook of its own, fitted by Lloyd's algorithm on a bounded sample, and
the product of the codebooks is a grid of cells that grows with the table. Every vector is stored in its home cell. A query's
neighbour lies, in either half, at least lb from the query, lb the distance of the query to the plane between its home centroid
and the neighbour's. The query sorts the centroids of each half by that bound and traverses the two lists in the
multi-sequence order, a heap that yields cells by rising lb1 squared + lb2 squared, until the bound of the target recall. That
bound is measured at fitting: sample vectors are turned by just the angle of the threshold in random directions, the hardest
neighbours there are, and the bound is the quantile, at the target recall, of their cells' sums. Candidates are
verified by cosine in double precision.

Equal vectors are one node. Cells are packed into shards of up to SHARD nodes in the order of the grid; a larger cell is
several shards. A query goes once to each shard that it visits, with the cells to look into, and of two cells the vectors of the lower
one do the visiting. The queries of a shard are dealt to as many tasks as their number asks for. A task holds one shard at a time and streams its
queries, and yields counts by vector and the links of a spanning forest, never pairs. In cells of more than LARGE nodes, those
within half the threshold's angle of the cell's mean direction are all linked; they are the cell's core, which is counted and
isn't compared with itself. So a cell or group of copies that holds a third of all rows is many tasks.

Defined cases: vectors that are null, empty, zero, of another length than most of the sample or that hold null or non-finite
components link with nothing; repeated rows of one id and vector count once and give one row; links at exactly the threshold
count; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import released, salted_join
from terrazone.llm.graph import components
from terrazone.session import cut

THRESHOLD, TARGET_RECALL = 0.9, 0.999
SAMPLE = 8192
#: Vectors of a cell that the codebooks are sized for, and the least and most centroids of a codebook; the most makes a million cells.
CELL, CENTROIDS = 800, (8, 1024)
#: Nodes of a shard, queries compared at once, queries that one task takes for a shard, and nodes of a cell that has a core.
SHARD, BATCH, QUERIES, LARGE = 8192, 512, 1 << 18, 4096


def unit_vectors(values: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector, and these as unit vectors in double precision."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    fits = sizes > 0 if dim is None else sizes == dim
    if not fits.any():
        return np.zeros(0, np.int64), np.zeros((0, dim or 0))
    width = dim or int(sizes[fits][0])
    at = np.flatnonzero(fits)
    x = pc.cast(values.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null components are NaN
    peak = np.abs(x).max(axis=1)
    good = np.isfinite(peak) & (peak > 0)
    at, x = at[good], x[good] / peak[good][:, None]
    return at, x / np.sqrt((x**2).sum(axis=1))[:, None]


def _unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from components as they came, 4 or 8 bytes each."""
    if not packed:
        return np.zeros((0, dim))
    x = np.frombuffer(b"".join(packed), np.float32 if len(packed[0]) == 4 * dim else np.float64).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def lloyd(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(11)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(axis=1)
        centers = np.array([x[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
    return centers


@dataclass(frozen=True)
class MultiIndex:
    dim: int
    books: tuple[np.ndarray, np.ndarray]
    bound: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.dim // 2], x[:, self.dim // 2 :]

    @cached_property
    def gaps(self) -> list[np.ndarray]:
        """Distances of the centroids of each half from one another."""
        squares = [(b**2).sum(1)[:, None] + (b**2).sum(1) - 2 * b @ b.T for b in self.books]
        return [np.sqrt(np.maximum(1e-12, q)) for q in squares]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cells, and the squared bound of every centroid of each half for every row."""
        home, squares = [], []
        for half, book, gaps in zip(self.halves(x), self.books, self.gaps):
            d = np.maximum(0, (half**2).sum(1)[:, None] + (book**2).sum(1) - 2 * half @ book.T)
            near = d.argmin(axis=1)
            lb = (d - d[np.arange(len(d)), near][:, None]) / (2 * gaps[near])
            lb[np.arange(len(d)), near] = 0
            home.append(near)
            squares.append(lb**2)
        return home[0] * len(self.books[1]) + home[1], squares

    def visits(self, squares: list[np.ndarray]) -> list[list[int]]:
        """The cells that each row visits, in multi-sequence order up to the bound."""
        n = len(self.books[1])
        order = [np.argsort(q, axis=1, kind="stable") for q in squares]
        sorted_ = [np.take_along_axis(q, o, axis=1).tolist() for q, o in zip(squares, order)]
        return [traverse(a, b, oa, ob, self.bound, n) for a, b, oa, ob in zip(*sorted_, *(o.tolist() for o in order))]


def traverse(a: list[float], b: list[float], first: list[int], second: list[int], bound: float, width: int) -> list[int]:
    """Multi-sequence: cells (first[i], second[j]) of two sorted lists by rising a[i] + b[j], until the sum passes the bound."""
    found: list[int] = []
    heap = [(a[0] + b[0], 0, 0)]
    reached = [0] * (len(a) + 1)  # places of the second list that each place of the first has yielded
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > bound:
            break
        found.append(first[i] * width + second[j])
        reached[i] = j + 1
        # a cell is pushed when the ones before it in its row and in its column have been yielded
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return found


def fit_index(df: DataFrame, column: str, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, centroids: int | None = None, sample: int = SAMPLE) -> MultiIndex | None:
    """Fit on about `sample` vectors, picked by hash."""
    rows = df.where(df[column].isNotNull()).select(df[column].alias("v"))
    total = rows.count()
    if not total:
        return None
    centroids = centroids or int(min(CENTROIDS[1], max(CENTROIDS[0], round((total / CELL) ** 0.5))))
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    values = [r.v for r in rows.where(place < F.lit(min(1.0, sample / total))).distinct().limit(2 * sample).collect()]
    values = sorted((v for v in values if v and None not in v and np.isfinite(v).all()), key=lambda v: hashlib.md5(np.array(v, np.float64).tobytes()).digest())
    if not values:
        values = [r.v for r in rows.limit(sample).collect() if r.v and None not in r.v]
    if not values:
        return None
    sizes = [len(v) for v in values]
    dim = max(set(sizes), key=sizes.count)
    _, x = unit_vectors(pa.array(values), dim)
    if not len(x):
        return None
    half = dim // 2
    index = MultiIndex(dim, (lloyd(x[:, :half], centroids), lloyd(x[:, half:], centroids)), 0.0)
    rng = np.random.default_rng(5)
    noise = rng.standard_normal((8, *x.shape)) if len(x) < 2048 else rng.standard_normal((1, *x.shape))
    found = []
    for part in noise:
        part -= (part * x).sum(1)[:, None] * x
        part /= np.maximum(1e-300, np.sqrt((part**2).sum(1)))[:, None]
        turned = threshold * x + (1 - threshold**2) ** 0.5 * part
        home, _ = index.bounds(turned)
        _, squares = index.bounds(x)
        n = len(index.books[1])
        found.append(squares[0][np.arange(len(x)), home // n] + squares[1][np.arange(len(x)), home % n])
    return MultiIndex(dim, index.books, float(np.quantile(np.concatenate(found), recall)))


def _place(index: MultiIndex, df: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, key (hash of the unit vector), its components as they came, home cell; the last three null where the vector isn't usable."""
    real = np.float32 if dict(df.dtypes)[column] == "array<float>" else np.float64

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            at, x = unit_vectors(batch.column("v"), index.dim)
            key, packed, cell = [None] * n, [None] * n, [None] * n
            if len(at):
                home, _ = index.bounds(x)
                given = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(real).reshape(len(at), -1)
                for i, row, c, v in zip(at, x, home, given):
                    packed[i] = v.tobytes()
                    key[i], cell[i] = hashlib.md5(row.tobytes()).hexdigest(), int(c)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "key": pa.array(key, pa.string()), "unit": pa.array(packed, pa.binary()), "cell": pa.array(cell, pa.int32())})

    kind = dict(df.dtypes)[id_col]
    return df.select(df[id_col].alias("id"), df[column].alias("v")).mapInArrow(run, f"id {kind}, key string, unit binary, cell int")


def _forest(stored: np.ndarray, asked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[str], list[str]]:
    """Links that connect what the links (stored[a], asked[b]) connect: one for each node but one of a component."""
    label_a, label_b = np.arange(len(stored)), np.full(len(asked), len(stored))
    while True:
        np.minimum.at(label_b, b, label_a[a])
        before = label_a.copy()
        np.minimum.at(label_a, a, label_b[b])
        label_a = label_a[label_a]
        if (before == label_a).all():
            break
    at, bt = np.unique(a), np.unique(b)
    return [*stored[at], *asked[bt]], [*stored[label_a[at]], *stored[label_b[bt]]]


@dataclass(frozen=True)
class Plan:
    """Where the parts of cells are stored. A part is twice the cell, and one more for its core; a part of many nodes is several units."""

    first: dict[int, int]  # part: its first unit
    units: dict[int, int]  # part: its units
    shard: np.ndarray  # unit: its shard
    start: np.ndarray  # shard: its first task
    tasks: np.ndarray  # shard: its tasks

    @staticmethod
    def of(size: dict[int, int], asked: dict[int, int] | None = None) -> Plan:
        first, units, shard, at, held = {}, {}, [], 0, 0
        for part in sorted(size):
            n = max(1, -(-size[part] // SHARD))
            first[part], units[part] = len(shard), n
            for _ in range(n):
                load = min(SHARD, size[part])
                if held and held + load > SHARD:
                    at, held = at + 1, 0
                shard.append(at)
                held += load
        tasks = np.array([max(1, -(-(asked or {}).get(k, 0) // QUERIES)) for k in range(at + 1)])
        return Plan(first, units, np.array(shard, np.int64), np.cumsum(tasks) - tasks, tasks)


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = TARGET_RECALL, centroids: int | None = None) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    index = fit_index(df, vector_col, threshold, recall, centroids)
    if index is None:
        return df.select(df[id_col], F.lit(0).cast("long").alias("n_links"), df[id_col].alias("component_id"), F.lit(True).alias("kept")).distinct()
    dim, angle = index.dim, float(np.arccos(threshold))
    core_angle = angle / 2 - 1e-7
    rows = cut(_place(index, df, id_col, vector_col), "vectors")
    usable = rows.where(F.col("key").isNotNull()).select("id", "key", "unit", "cell").distinct()
    nodes = cut(usable.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"), F.first("cell").alias("cell")), "nodes")

    # numbers of nodes by cell, and mean directions of the large cells alone: a row for each cell of the grid at most
    size = {2 * r.cell: r.n for r in nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [part // 2 for part, n in size.items() if n > LARGE]
    center: dict[int, np.ndarray] = {}
    if large:

        def sums(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x, cell = _unpack(batch.column("unit").to_pylist(), dim), np.array(batch.column("cell"))
                for c in np.unique(cell):
                    total[int(c)] = total.get(int(c), np.zeros(dim)) + x[cell == c].sum(axis=0)
            if total:
                yield pa.RecordBatch.from_pydict({"cell": pa.array(list(total), pa.int32()), "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

        summed = nodes.where(F.col("cell").isin(large) if len(large) <= 1000 else F.lit(True)).select("unit", "cell").mapInArrow(sums, "cell int, v array<double>")
        for r in summed.groupBy("cell").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(dim)]).collect():
            v = np.array(r[1:])
            if r.cell in large:
                center[r.cell] = v / (np.sqrt(v @ v) or 1.0)

        def cored(batches):
            for batch in batches:
                x, cell = _unpack(batch.column("unit").to_pylist(), dim), np.array(batch.column("cell"))
                core = np.zeros(len(cell), bool)
                for c in np.unique(cell):
                    if int(c) in center:
                        at = np.flatnonzero(cell == c)
                        core[at] = np.arccos(np.clip(x[at] @ center[int(c)], -1, 1)) <= core_angle
                yield batch.append_column("core", pa.array(core))

        nodes = cut(nodes.mapInArrow(cored, "key string, least " + dict(nodes.dtypes)["least"] + ", n long, unit binary, cell int, core boolean"), "nodes")
        size = {2 * r.cell + r.core: r.n for r in nodes.groupBy("cell", "core").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        nodes = nodes.withColumn("core", F.lit(False))
    wholes = Plan.of(size)

    def asks(x: np.ndarray, core: np.ndarray, home: np.ndarray, squares: list[np.ndarray]) -> list[list[int]]:
        """The parts that each node looks into."""
        out = []
        for k, cells in enumerate(index.visits(squares)):
            parts = [2 * int(home[k])]  # a core isn't compared with itself; the rest of a cell is asked by all of it
            for c in cells:
                if c > home[k]:
                    parts.append(2 * c)
                    if 2 * c + 1 in size:
                        parts.append(2 * c + 1)
            # no link reaches a core from farther than its radius and the angle
            out.append([p for p in parts if p in size and (p % 2 == 0 or np.arccos(np.clip(x[k] @ center[p // 2], -1, 1)) <= core_angle + angle + 1e-7)])
        return out

    def place(plan: Plan, stored: bool):
        """Rows of each node: stored once for each task of its unit's shard, asking once in each shard that it visits."""

        def run(batches):
            for big in batches:
                for at in range(0, big.num_rows, 2048):
                    batch = big.slice(at, 2048)
                    x, home, core = _unpack(batch.column("unit").to_pylist(), dim), np.array(batch.column("cell")), batch.column("core").to_numpy(zero_copy_only=False)
                    keys = batch.column("key").to_pylist()
                    _, squares = index.bounds(x)
                    task, kind, row, unit, parts_ = [], [], [], [], []
                    for k, parts in enumerate(asks(x, core, home, squares)):
                        own = 2 * int(home[k]) + int(core[k])
                        salt = int(keys[k][:12], 16)
                        sub = plan.first[own] + salt % plan.units[own]
                        spot = int(plan.shard[sub])
                        if stored:
                            for t in range(int(plan.tasks[spot])):
                                task.append(int(plan.start[spot]) + t)
                                kind.append(0)
                                row.append(k)
                                unit.append(sub)
                                parts_.append([])
                        wanted: dict[int, list[int]] = {}
                        for p in parts:
                            # of a part of several units a node asks its own unit and those after it
                            begin = sub if p == own else plan.first[p]
                            for s in dict.fromkeys(plan.shard[begin : plan.first[p] + plan.units[p]].tolist()):
                                wanted.setdefault(s, []).append(p)
                        for s, many in wanted.items():
                            task.append(int(plan.start[s]) + (salt >> 20) % int(plan.tasks[s]))
                            kind.append(1)
                            row.append(k)
                            unit.append(sub)
                            parts_.append(many)
                    yield pa.RecordBatch.from_pydict(
                        {"task": pa.array(task, pa.int64()), "kind": pa.array(kind, pa.int32()), "unit_no": pa.array(unit, pa.int64()), "part": pa.array((2 * home + core)[row], pa.int64()), "parts": pa.array(parts_, pa.list_(pa.int64())), "key": batch.column("key").take(pa.array(row, pa.int64())), "n": batch.column("n").take(pa.array(row, pa.int64())), "unit": batch.column("unit").take(pa.array(row, pa.int64()))}
                    )

        return run

    # queries of each shard: where one has more than a task takes, its stored nodes go to several tasks
    slots = max(1, int(wholes.shard[-1]) + 1) if len(wholes.shard) else 1
    plan = wholes
    if sum(size.values()) > QUERIES:

        def counting(batches):
            for out in place(wholes, False)(batches):
                task, n = np.unique(np.array(out.column("task")), return_counts=True)
                yield pa.RecordBatch.from_pydict({"task": pa.array(task, pa.int64()), "asked": pa.array(n, pa.int64())})

        asked = nodes.select("key", "n", "unit", "cell", "core").mapInArrow(counting, "task long, asked long").groupBy("task").agg(F.sum("asked").alias("asked"))
        plan = Plan.of(size, {r.task: r.asked for r in asked.collect()})  # a row a shard
        slots = int(plan.tasks.sum())
    placed = nodes.select("key", "n", "unit", "cell", "core").mapInArrow(place(plan, True), "task long, kind int, unit_no long, part long, parts array<long>, key string, n long, unit binary")
    dealt = placed.repartition(max(1, min(slots, 1 << 16)), "task").sortWithinPartitions("task", "kind")

    class Shard:
        """The stored nodes of one task, by unit, and what its queries found for them."""

        def __init__(self, task: int):
            self.task, self.rows, self.open = task, [], True

        def add(self, batch: pa.RecordBatch) -> None:
            self.rows.append(batch)

        def close(self) -> None:
            self.open = False
            whole = pa.Table.from_batches(self.rows)
            self.rows = []
            unit = whole.column("unit_no").to_numpy()
            order = np.argsort(unit, kind="stable")
            self.x = _unpack(whole.column("unit").to_pylist(), dim)[order]
            self.key, self.n = np.array(whole.column("key").to_pylist(), object)[order], whole.column("n").to_numpy()[order]
            self.back = np.zeros(len(order), np.int64)
            unit, part = unit[order], whole.column("part").to_numpy()[order]
            self.spans: dict[int, list[tuple[int, int, int]]] = {}
            for lo in np.flatnonzero(np.append(True, unit[1:] != unit[:-1])).tolist():
                hi = int(np.searchsorted(unit, unit[lo], "right"))
                self.spans.setdefault(int(part[lo]), []).append((int(unit[lo]), lo, hi))

        def ask(self, batch: pa.RecordBatch):
            x, key, n = _unpack(batch.column("unit").to_pylist(), dim), np.array(batch.column("key").to_pylist(), object), np.array(batch.column("n"))
            own_part, own_unit, parts = np.array(batch.column("part")), np.array(batch.column("unit_no")), batch.column("parts").to_pylist()
            by_part: dict[int, list[int]] = {}
            for k, many in enumerate(parts):
                for p in many:
                    by_part.setdefault(p, []).append(k)
            count = np.zeros(len(key), np.int64)
            hits_a, hits_b = [], []
            for p, who in by_part.items():
                who = np.array(who)
                for number, lo, hi in self.spans.get(p, ()):
                    asking = who[(own_part[who] != p) | (own_unit[who] <= number)]
                    if not len(asking):
                        continue
                    near = self.x[lo:hi] @ x[asking].T >= threshold
                    same = own_unit[asking] == number
                    if same.any():
                        near[:, same] &= self.key[lo:hi, None] != key[asking[same]]
                    a, b = np.nonzero(near)
                    if not len(a):
                        continue
                    count += np.bincount(asking[b], self.n[lo + a], len(key)).astype(np.int64)
                    # within a unit each of a pair asks for the other; any other meeting counts for the stored one as well
                    other = ~same[b]
                    self.back += np.bincount(lo + a[other], n[asking[b[other]]], len(self.back)).astype(np.int64)
                    hits_a.append(lo + a)
                    hits_b.append(asking[b])
            hit = np.flatnonzero(count)
            one, two = _forest(self.key, key, np.concatenate(hits_a), np.concatenate(hits_b)) if hits_a else ([], [])
            yield _found([*key[hit], *one], [*count[hit].tolist(), *[None] * len(one)], [*[None] * len(hit), *two])

        def told(self):
            met = np.flatnonzero(self.back)
            yield _found(self.key[met].tolist(), self.back[met].tolist(), [None] * len(met))

    def compare(batches):
        shard = None
        for whole in released(batches):
            tasks, kinds = np.array(whole.column("task")), np.array(whole.column("kind"))
            edges = np.flatnonzero(np.append(True, (tasks[1:] != tasks[:-1]) | (kinds[1:] != kinds[:-1]))).tolist() if whole.num_rows else []
            for lo, hi in zip(edges, [*edges[1:], whole.num_rows]):
                if shard is None or shard.task != tasks[lo]:
                    if shard is not None and not shard.open:
                        yield from shard.told()
                    shard = Shard(int(tasks[lo]))
                if kinds[lo] == 0:
                    shard.add(whole.slice(lo, hi - lo))
                    continue
                if shard.open:
                    shard.close()
                for at in range(lo, hi, BATCH):
                    yield from shard.ask(whole.slice(at, min(BATCH, hi - at)))
        if shard is not None and not shard.open:
            yield from shard.told()

    found = cut(dealt.mapInArrow(compare, "key string, count long, other string"), "found")
    if center:
        # cores: linked throughout, so counts and one link to the least key are enough; a row for each large cell
        cores = nodes.where("core").groupBy("cell").agg(F.sum("n").alias("all"), F.min("key").alias("other"))
        sure = nodes.where("core").select("cell", "key", F.col("n").alias("own")).join(F.broadcast(cores), "cell")
        found = found.unionByName(sure.select("key", (F.col("all") - F.col("own")).alias("count"), "other"))
    label = cut(components(found.where(F.col("other").isNotNull()).select("key", "other"), "key", "other"), "labels")
    counts = found.where(F.col("count").isNotNull()).groupBy("key").agg(F.sum("count").alias("count"))
    told = nodes.select("key", "least", "n").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    told = cut(told.join(counts, "key", "left").select("key", "label", "least", "n", (F.coalesce("count", F.lit(0)) + F.col("n") - 1).alias("n_links")), "told")
    told = salted_join(told, told.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("key", "n", "n_links", "component_id")
    linked = salted_join(usable.select("id", "key"), told.select("key", "n_links", "component_id"), "key").select("id", "n_links", "component_id")
    alone = rows.where(F.col("key").isNull()).select("id").distinct().select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _found(key: list, count: list, other: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.string()), "count": pa.array(count, pa.int64()), "other": pa.array(other, pa.string())})

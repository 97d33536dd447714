"""Nearest neighbours by adaptive dimension scans of the lists of an inverted file."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.shared import materialize

#: Vectors, at most, on which the index (rotation, lists, bounds) is fitted, and so many for each list; every vector is indexed.
SAMPLE_ROWS, SAMPLE_PER_LIST = 65_536, 64
#: Bytes of vectors, at most, in that sample; it is held in the driver, and a copy of it in each worker.
SAMPLE_BYTES = 96 << 20
#: Vectors over so many times the sample's median length are long; those in steps of such a factor share a list.
LONG, STEP = 4.0, 16.0
#: Queries of a cell, about, that one task holds; more of them take further tasks with the cell's vectors.
QUERIES = 50_000
#: Lists for each root of the number of vectors, and vectors that a list has on average at least.
LISTS_PER_ROOT, LIST_ROWS = 0.5, 256
#: Share of the sample's own nearest neighbours that the probed lists must hold, and vectors asked to measure it.
RECALL, TRIED = 0.93, 256
#: Lists are scanned in cells of about so many vectors; a list of over MOST is dealt to several cells.
VECTORS, MOST = 8192, 32_768
#: One in so many vectors gives a query its first bound (they are no candidates for that).
PILOT = 8
#: Vectors by queries that a scan takes on before it draws its bounds closer.
STRIDE, ASKED = 2048, 512
#: Dimensions that a scan adds before each test, and the slack of the test (larger: fewer wrong rejections).
COLUMNS, SLACK = 16, 2.1
#: Pairs of a tile, as a share, below which the scan goes on pair by pair.
DENSE = 0.1
SEED = 17


def lists_for(n: int) -> int:
    return max(1, round(min(LISTS_PER_ROOT * math.sqrt(n), n / LIST_ROWS)))


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms of rows, of any finite magnitude."""
    most = np.abs(x).max(axis=1, initial=0.0)
    unit = x / np.where(most > 0, most, 1.0)[:, None]
    return most * np.sqrt((unit * unit).sum(axis=1))


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    reach: float  # of the vectors that have lists around centres: none is longer
    pilot: np.ndarray  # vectors of the sample, divided by their own reach, and that reach
    probes: int
    cells: list[tuple[int, int]]  # of each list: the first of its cells and how many they are
    always: list[int]  # steps of long vectors; each has a list behind those around centres, which all queries search

    def steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector its step (0 but for long ones) and the reach of the step."""
        size = lengths(x)
        step = np.zeros(len(x), np.int64)
        long = size > self.reach * (1 + 1e-12)
        with np.errstate(over="ignore"):
            step[long] = np.maximum(1, np.ceil(np.log(size[long] / self.reach) / math.log(STEP) - 1e-12)).astype(np.int64)
        return step, self.reaches(step)

    def reaches(self, step: np.ndarray) -> np.ndarray:
        return np.minimum(self.reach * STEP ** np.minimum(step, 400).astype(float), np.finfo(float).max) if len(step) else np.empty(0)

    def place(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Vectors divided by their reach, with one more number that makes them of length 1, rotated: then, among
        vectors of one reach, the largest inner product with a query (whose number is 0) is the least distance."""
        x = x / reach[:, None]
        more = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))
        return np.column_stack([x, more]) @ self.rotation

    def ask(self, q: np.ndarray) -> np.ndarray:
        """Queries of length 1, which changes no order."""
        most = np.abs(q).max(axis=1, initial=0.0)
        q = q / most[:, None]
        return np.column_stack([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros(len(q))]) @ self.rotation

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """Of each vector the n lists with the nearest centres, nearest first."""
        n, out = min(n, len(self.centres)), []
        for at in range(0, len(x), ASKED):
            far = (self.centres**2).sum(axis=1) - 2 * (x[at : at + ASKED] @ self.centres.T)
            near = np.argpartition(far, n - 1, axis=1)[:, :n]
            out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1))
        return np.concatenate(out) if out else np.empty((0, n), np.int64)

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """Of each query (asked) the k-th largest inner product in the pilot, which that in the whole table is no less than."""
        out = np.full(len(q), -np.inf)
        if len(self.pilot) >= k:
            x, reach = self.pilot[:, :-1], self.pilot[:, -1]
            plain = (q @ self.rotation.T)[:, :-1]
            for at in range(0, len(q), ASKED):
                near = (plain[at : at + ASKED] @ x.T) * reach
                out[at : at + ASKED] = np.partition(near, len(x) - k, axis=1)[:, len(x) - k]
        return out - 1e-9 * np.abs(np.where(np.isfinite(out), out, 0.0))


def to_distance(least: np.ndarray, reach: float | np.ndarray) -> np.ndarray:
    """Squared distance, in the space of a reach, within which inner products of a unit query are at least so large."""
    with np.errstate(over="ignore"):
        return (2 - 2 * (least / reach)) * (1 + 1e-9) + 1e-9


def fit(sample: np.ndarray, longest: float, n: int, k: int, lists: int | None = None, probes: int | None = None, recall: float = RECALL, rounds: int = 8) -> Index:
    """A random rotation, lists around k-means centres of the sample, and room for n vectors' cells.

    The reach is the longest vector's length, or LONG times the sample's median length if that is less:
    a few very long vectors do not make all others look alike. Without a number of probes, the least is
    taken with which the sample's k nearest (of no long vectors) to some of its own vectors are found at
    the wanted share. In a larger table the nearest are nearer, and so found sooner."""
    rng = np.random.default_rng(SEED)
    d = sample.shape[1] + 1
    index = Index(np.linalg.qr(rng.normal(size=(d, d)))[0], np.zeros((1, d)), min(longest, LONG * float(np.median(lengths(sample)))), np.zeros((0, d)), 1, [], [])
    step, reach = index.steps(sample)
    index.pilot = np.column_stack([sample / reach[:, None], reach])[: n // PILOT]
    short = sample[step == 0]
    x = index.place(short, reach[step == 0])
    index.centres = x[rng.permutation(len(x))[: lists or lists_for(n)]]
    for _ in range(rounds):
        own = index.lists(x, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        index.centres[used] = np.add.reduceat(x[order], first, axis=0) / np.diff([*first, len(x)])[:, None]
    own = index.lists(x, 1)[:, 0]
    index.probes = probes or _probes(index, short, own, k, recall)
    index.cells = _cells(np.bincount(own, minlength=len(index.centres)) * (n / len(x)), 0)
    return index


def _cells(sizes: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Lists of such sizes packed into cells in their order, from a cell on."""
    cells, cell, filled = [], first, 0.0
    for held in sizes:
        if held > MOST:
            cell += filled > 0
            cells.append((cell, math.ceil(held / MOST)))
            cell, filled = cell + cells[-1][1], 0.0
            continue
        if filled and filled + held > VECTORS:
            cell, filled = cell + 1, 0.0
        cells.append((cell, 1))
        filled += held
    return cells


def _probes(index: Index, sample: np.ndarray, own: np.ndarray, k: int, recall: float) -> int:
    tried = sample[:TRIED]
    score = (tried / index.reach) @ (sample / index.reach).T
    score[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(index.centres)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(index.lists(index.ask(tried), len(index.centres)), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), recall, method="higher")) + 1


def scan(vectors: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, slack: float = SLACK, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the pairs that may be among a query's k nearest; bounds are drawn closer in place.

    Tiles of vectors by queries add block after block of columns. The squared distance over the d of D
    rotated dimensions seen so far, times D / d, estimates the whole one; a pair is given up once that is
    so far above the query's bound that the hypothesis of its being nearer is rejected. While many pairs
    of a tile are left, a block is one product of matrices; then it goes on with those that are left. What
    reaches the last block has its whole distance, and the k-th least so far is the query's bound."""
    full = vectors.shape[1]
    held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for to in range(0, len(queries), ASKED):
        asked, bound = queries[to : to + ASKED], bounds[to : to + ASKED]
        mine = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for first in range(0, len(vectors), STRIDE):
            tile = vectors[first : first + STRIDE]
            part, stay, pairs = np.zeros((len(asked), len(tile))), np.ones((len(asked), len(tile)), bool), None
            for at in range(0, full, columns):
                a, b, seen = asked[:, at : at + columns], tile[:, at : at + columns], min(full, at + columns)
                limit = bound if seen == full else bound * seen / full * (1 + slack / math.sqrt(seen)) ** 2
                if pairs is None:
                    part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
                    stay &= part <= limit[:, None]
                    if seen == full or stay.mean() < DENSE:
                        i, j = np.nonzero(stay)
                        pairs = i, j, part[i, j]
                else:
                    i, j, far = pairs
                    step = a[i] - b[j]
                    far = far + np.einsum("ij,ij->i", step, step)
                    left = far <= limit[i]
                    pairs = i[left], j[left], far[left]
                if pairs and not len(pairs[0]):
                    break
            i, j, far = (np.concatenate(x) for x in zip(mine, (pairs[0], pairs[1] + first, pairs[2]), strict=True))
            order = np.lexsort((far, i))
            i, j, far = i[order], j[order], far[order]
            begin = np.searchsorted(i, np.arange(len(asked)))
            enough = np.flatnonzero(np.diff([*begin, len(i)]) >= k)
            # distances as near as rounding tells stay, for the exact scores to settle
            bound[enough] = np.minimum(bound[enough], far[begin[enough] + k - 1] * (1 + 1e-9) + 1e-9)
            left = far <= bound[i]
            mine = i[left], j[left], far[left]
        held = tuple(np.concatenate(x) for x in zip(held, (mine[0] + to, *mine[1:]), strict=True))
    return held


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    """A list column whose lists are equally long."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


FOUND = {"q1": pa.int64(), "q2": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "score": pa.float64()}


def search(
    table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    lists: int | None = None, probes: int | None = None, recall: float = RECALL, slack: float = SLACK,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, ties to smaller ids.

    Lists grow with the root of the table, and the probed share is measured on the sample; given numbers
    override both. With probes = lists and an infinite slack the search is exact. All results come from
    the probed lists; a query that finds fewer than k there while there are more looks through all lists.

    Lengths may be of any finite magnitude: vectors are compared after division by a power of their size,
    queries at length 1, and the few that are very long have lists of their own, which every query searches.
    Null or zero vectors, ones with a null or non-finite number, and null ids take no part; vectors of
    another length than the most frequent one do not either. A query is no candidate of its own. Rows
    that repeat an id with the same vector are one; of different vectors of one id, one takes part, the
    least by a hash of its numbers. Equal vectors are searched once: of them, the k + 1 smallest ids can
    be results, which is exact, and queries that share a vector share its search. Vectors are shuffled
    once, by the cell of their list, and a query goes once to each cell that it probes; a list of many
    vectors is dealt to several cells, and where more than QUERIES probe a cell they are dealt to chunks, each
    with the cell's vectors. Scores are inner products of the original vectors in double
    precision. An empty table gives an empty one; other columns are not read.
    """
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("v") == common.d).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    whole = materialize(rows.groupBy("id").agg(F.min(F.struct("k1", "k2", "v", "q")).alias("x")).select("id", "x.*"), "vectors")
    least = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    kept = materialize(whole.select("id", "k1", "k2", "v", least.alias("_n")).filter(F.col("_n") <= k + 1), "candidates")
    asking, distinct = whole.filter("q").select("id", "k1", "k2"), kept.filter("_n = 1").select("k1", "k2", "v")

    top = F.array_max(F.transform("v", F.abs))
    norm = top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()
    longest = min(longest, np.finfo(float).max)
    most = min(SAMPLE_ROWS, SAMPLE_PER_LIST * (lists or lists_for(n)), max(TRIED, SAMPLE_BYTES // (8 * common.d)))
    # about as many rows by a hash, so that no task sorts more than its share of them
    share = math.ceil(1.2 * most / n * (1 << 30))
    sample = distinct.filter(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("k2", "k1"), "k1", "k2").limit(most).select("v").toArrow()
    index = fit(_matrix(sample["v"]), longest, n, k + 1, lists, probes, recall) if sample.num_rows else fit(_matrix(distinct.limit(1).select("v").toArrow()["v"]), longest, n, k + 1, lists, probes, recall)
    # long vectors are in few steps; each is a list behind the others, known by its number of vectors
    held = distinct.select("v").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(index.steps(_matrix(b.column("v")))[0])], names=["step"]) for b in batches if b.num_rows), "step long")
    counted = held.filter("step > 0").groupBy("step").count().orderBy("step").collect() if longest > index.reach else []
    index.always = [r.step for r in counted]
    index.cells += _cells(np.array([r["count"] for r in counted], float), max(c + m for c, m in index.cells))
    n_queries = asking.select("k1", "k2").distinct().count()
    chunks = max(1, math.ceil(n_queries * min(1, (index.probes + len(index.always)) / len(index.cells)) / QUERIES))
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index = shared.value
                x = _matrix(batch.column("v"))
                step, reach = index.steps(x)
                own = len(index.centres) + np.searchsorted(index.always, step)
                plain = step == 0
                own[plain] = index.lists(index.place(x[plain], reach[plain]), 1)[:, 0]
                first, cells = np.array(index.cells)[own].T
                cell = first + (batch.column("k1").to_numpy() % cells)
                for chunk in range(chunks):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(cell, pa.int32()), pa.array(np.full(len(own), chunk), pa.int32())], names=["k1", "k2", "v", "list", "cell", "chunk"])

    def ask(all_lists: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ASKED):
                    index, batch = shared.value, whole.slice(at, ASKED)
                    q = index.ask(_matrix(batch.column("v")))
                    near = index.lists(q, len(index.centres) if all_lists else index.probes)
                    bound = np.full(len(q), -np.inf) if all_lists else index.bounds(q, k + 1)
                    chunk = batch.column("k1").to_numpy() % chunks
                    long = range(len(index.centres), len(index.cells))
                    row, cell, probed = [], [], []
                    for i, own in enumerate(near.tolist()):
                        own += long
                        by_cell: dict[int, list[int]] = {}
                        for one in own:
                            for c in range(index.cells[one][1]):
                                by_cell.setdefault(index.cells[one][0] + c, []).append(one)
                        row += [i] * len(by_cell)
                        cell += by_cell
                        probed += by_cell.values()
                    took = batch.take(pa.array(row, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell, pa.int32()), pa.array(probed, pa.list_(pa.int32())), pa.array(bound[row]), pa.array(chunk[row], pa.int32())], names=["k1", "k2", "v", "cell", "lists", "bound", "chunk"])

        return run

    def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            index = shared.value
            own = vectors["list"].to_numpy()
            x, q, bounds = _matrix(vectors["v"]), _matrix(queries["v"]), queries["bound"].to_numpy().copy()
            reach = index.steps(x)[1]
            placed, asked = index.place(x, reach), index.ask(q)
            probed = queries["lists"].combine_chunks()
            who = np.repeat(np.arange(len(q)), np.diff(probed.offsets.to_numpy()))
            which = probed.flatten().to_numpy()
            pairs = []
            for one in np.unique(own):
                at, by = np.flatnonzero(own == one), who[which == one]
                if len(by):
                    closer = to_distance(bounds[by], reach[at[0]])
                    i, j, far = scan(placed[at], asked[by], closer, k + 1, slack)
                    bounds[by] = np.maximum(bounds[by], reach[at[0]] * (1 - closer / 2))
                    pairs.append((by[i], at[j], far))
            if pairs:
                i, j, far = map(np.concatenate, zip(*pairs, strict=True))
                left = far <= to_distance(bounds[i], reach[j])
                i, j = i[left], j[left]
                k1, k2, q1, q2 = (t[c].to_numpy() for t in (vectors, queries) for c in ("k1", "k2"))
                for to in range(0, len(i), 1 << 16):
                    a, b = i[to : to + (1 << 16)], j[to : to + (1 << 16)]
                    found.append([q1[a], q2[a], k1[b], k2[b], (x[b] * q[a]).sum(axis=1)])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * len(FOUND)
        return pa.table([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, FOUND.values(), strict=True)], names=list(FOUND))

    left = distinct.mapInArrow(deal, "k1 long, k2 long, v array<double>, list int, cell int, chunk int")
    kind = "k1 long, k2 long, v array<double>, cell int, lists array<int>, bound double, chunk int"
    # vectors as near as the (k + 1)-th, which may hold smaller ids, stay: rank() leaves ties in
    near = F.rank().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score")))

    def best(queries: DataFrame, all_lists: bool) -> DataFrame:
        met = left.groupBy("cell", "chunk").cogroup(queries.mapInArrow(ask(all_lists), kind).groupBy("cell", "chunk")).applyInArrow(compare, ", ".join(f"{c} {'double' if c == 'score' else 'long'}" for c in FOUND))
        return materialize(met.withColumn("_r", near).filter(F.col("_r") <= k + 1), "top")

    once = distinct.join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    top = best(once, False)
    done = top.groupBy("q1", "q2").count().filter(F.col("count") >= min(k + 1, n)).select(F.col("q1").alias("k1"), F.col("q2").alias("k2"))
    short = materialize(once.join(done, ["k1", "k2"], "left_anti"), "short")
    if not short.isEmpty():
        again = F.broadcast(short.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"))) if short.count() <= SAMPLE_ROWS else short.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"))
        top = top.join(again, ["q1", "q2"], "left_anti").unionByName(best(short, True))
    ids = top.join(kept.select("k1", "k2", "id"), ["k1", "k2"])
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id")
    ids = materialize(ids.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "score"))).alias("near")), "near")
    answered = asking.join(ids, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    ranked = answered.select("query_id", F.posexplode("near").alias("_at", "n"))
    return ranked.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score"))

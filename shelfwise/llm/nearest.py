"""Approximate nearest neighbours: inverted lists scanned by growing partial distances.

Vectors are turned by one random rotation and filed under the nearest of a set of
centres. A query probes the lists of its nearest centres, as many
as queries drawn from the fitting sample need to reach a wanted recall in it. Within a list, candidates
lie in blocks of columns; the scan adds one block after the other, and after each a
test asks whether the distance seen so far already shows, at a chosen error rate, that
the whole distance is beyond the query's tenth best: for a rotated vector the first d
of D columns hold about d/D of the squared distance, with a relative error that falls
as 1/sqrt(d). What fails is abandoned with its other columns unread. Survivors get
their exact distance, in double precision on the original vectors.

Vectors that are null, empty, zero, hold a null or a non-finite component, or have
another length than most take no part, neither as query nor as candidate. Rows that
share an id are each a candidate; a query leaves out rows with its own id. Equal
distances go to the smaller id. An empty table has no answers.

The centres are fitted on a bounded sample (``Plan``); every vector is filed. A list, or
the queries that probe it, may be of any size: both are cut into blocks, and a task
gets one block of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.llm.workers import ship_code
from shelfwise.sources.scratch import staged


@dataclass(frozen=True)
class Plan:
    list_size: int = 256         # vectors aimed at per list
    most_centres: int = 8192     # bounds the centres, which go to every executor
    sample: int = 20_000         # vectors the centres and the number of probes are fitted on
    trials: int = 200            # of them, asked in the sample to find how many lists to probe
    recall: float = 0.96         # that the trials must reach
    least_seen: int = 4000       # vectors that a query sees at least, if there are as many
    block_rows: int = 4096       # vectors and queries of a list that one task takes
    block_queries: int = 512
    columns: int = 16            # columns of a block
    strictness: float = 2.1      # of the test: higher abandons less
    seed: int = 7


def usable(vector: Column) -> Column:
    """The vector in double precision, or null if it takes no part."""
    x = vector.cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when((F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0), x)


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _centres(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(sample, centres, 1)[:, 0]
        sums = np.column_stack([np.bincount(at, column, minlength=k) for column in sample.T])
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    norms = (centres ** 2).sum(axis=1)
    for a in range(0, len(x), 1024):
        d = norms - 2 * x[a:a + 1024] @ centres.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(n), d.shape)
        out[a:a + 1024] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, plan: Plan) -> int:
    """How many lists the trials must probe so that they find ``plan.recall`` of their neighbours in the sample.

    Neighbours in the whole table are no farther than those in the sample, so their lists are no farther down.
    """
    trials = sample[:plan.trials]
    d = (sample ** 2).sum(axis=1) - 2 * trials @ sample.T
    d[np.arange(len(trials)), np.arange(len(trials))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    place = np.argsort(_nearest(trials, centres, len(centres)), axis=1)
    down = np.take_along_axis(place, _nearest(sample, centres, 1)[:, 0][true], 1)
    return int(np.quantile(down, plan.recall, method="higher")) + 1


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
           plan: Plan = Plan()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row where ``queries`` holds."""
    spark = vectors.sparkSession
    ship_code(spark)
    clean = (vectors.select(F.col(key).alias("vec_id"), usable(F.col(vector)).alias("v"), queries.alias("asks"))
             .filter("v is not null and vec_id is not null"))
    dims = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = dims[0]
    clean = clean.filter(F.size("v") == dim)

    turn = _rotation(dim, plan.seed)
    order = F.xxhash64("vec_id")
    share = min(1.0, 1.2 * plan.sample / total)
    fitted = (clean.filter(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v")
              .limit(plan.sample).toArrow()["v"])
    sample = _matrix(fitted, dim) @ turn if len(fitted) else np.zeros((1, dim))
    centres = _centres(sample, max(1, min(total // plan.list_size, plan.most_centres, len(sample))), plan.seed)

    n_probes = _probes(sample, centres, k, plan)

    def file(batches):
        for batch in batches:
            if batch.num_rows:
                at = _nearest(_matrix(batch.column("v"), dim) @ turn, centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["vec_id", "v", "asks", "list"])

    filed = staged(clean.mapInArrow(file, "vec_id long, v array<double>, asks boolean, list int"), "filed")
    sizes = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}  # at most ``most_centres`` rows
    held = np.array([sizes.get(i, 0) for i in range(len(centres))])

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _nearest(_matrix(batch.column("v"), dim) @ turn, centres, len(centres))
            seen = np.cumsum(held[near], axis=1)
            # The list before has neither shown enough vectors nor been the last probe.
            going = (np.arange(len(centres)) < n_probes) | (seen - held[near] < max(plan.least_seen, k + 1))
            row, at = np.nonzero(going & (held[near] > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)),
                 pa.array(near[row, at].astype(np.int32))], names=["query_id", "q", "list"])

    probes = (filed.filter("asks").select("vec_id", "v").mapInArrow(probe, "query_id long, q array<double>, list int")
              .withColumn("query_block", F.xxhash64("query_id")))
    asked = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}  # at most ``most_centres`` rows

    def blocks(counts: dict, most: int) -> DataFrame:
        return spark.createDataFrame([(i, -(-n // most)) for i, n in counts.items()] or [(-1, 1)], "list int, blocks int")

    n_rows, n_asks = blocks(sizes, plan.block_rows), blocks(asked, plan.block_queries).withColumnRenamed("blocks", "query_blocks")
    grid = F.broadcast(n_rows.join(n_asks, "list"))  # at most ``most_centres`` rows
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (filed.select("list", "vec_id", "v").join(grid, "list")
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("query_block", numbers("query_blocks")))
    asks = (probes.join(grid, "list").withColumn("query_block", F.pmod("query_block", "query_blocks").cast("int"))
            .withColumn("block", numbers("blocks")))
    place = ["list", "block", "query_block"]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _scan(_matrix(right.column("q"), dim), np.asarray(right.column("query_id")), _matrix(left.column("v"), dim),
                      np.asarray(left.column("vec_id")), turn, k, plan) if left.num_rows and right.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})

    found = (rows.select(*place, "vec_id", "v").groupBy(*place)
             .cogroup(asks.select(*place, "query_id", "q").groupBy(*place))
             .applyInArrow(scan, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int,
          plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of each query within one block, as three columns."""
    dim = rows.shape[1]
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    turned, asked = rows @ turn, queries @ turn
    cuts = [*range(0, dim, plan.columns), dim]
    columns = [np.ascontiguousarray(turned[:, a:b].T) for a, b in zip(cuts, cuts[1:])]  # one column after the other
    out = ([], [], [])
    for q, name, wanted in zip(asked, query_ids, queries):
        at = np.flatnonzero(ids != name)
        if not len(at):
            continue
        exact = lambda some: np.sqrt(((rows[some] - wanted) ** 2).sum(axis=1))
        first = at[np.linspace(0, len(at) - 1, min(len(at), 4 * k)).astype(int)]
        limit = np.sort(exact(first))[min(k, len(first)) - 1] if len(first) >= k else np.inf
        partial = np.zeros(len(at))
        for block, a, b in zip(columns, cuts, cuts[1:]):
            partial += ((block[:, at] - q[a:b, None]) ** 2).sum(axis=0)
            if np.isfinite(limit) and b < dim:
                bound = limit ** 2 * min(1.0, b / dim * (1 + plan.strictness / np.sqrt(b)) ** 2)
                stays = partial <= bound + 1e-9
                at, partial = at[stays], partial[stays]
        if np.isfinite(limit):  # all columns are in: the same margin as for rounding
            at = at[partial <= limit ** 2 * (1 + 1e-9) + 1e-9]
        scores = exact(at)
        best = np.lexsort((ids[at], scores))[:k]
        out[0].append(np.full(len(best), name))
        out[1].append(ids[at[best]])
        out[2].append(scores[best])
    return tuple(np.concatenate(x) if x else np.array([]) for x in out)

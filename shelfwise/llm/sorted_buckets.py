"""Which records share their leading tokens? Sorted in range buckets, compared across their boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.workers import forget_others, give_back
from shelfwise.sources.scratch import staged

#: Records of a bucket, all of which one task sorts.
BUCKET = 400_000


def multikey_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by the first token; only records that tie there are sorted by the second."""
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    tied = np.zeros(len(order), bool)
    tied[1:] = ranked[1:] == ranked[:-1]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    order[at] = order[at][np.lexsort((second[order[at]], ranked[at]))]
    return order


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket in order, without records that nothing here or beyond the boundaries can equal.

    The bucket is held once; only the records that stay are copied.
    """
    forget_others()
    out = _kept(list(batches))
    if out is not None:
        yield from out.to_batches(max_chunksize=50_000)
    out = None
    give_back()


def _kept(parts: list[pa.RecordBatch]) -> pa.Table | None:
    table = pa.Table.from_batches(parts) if parts else None
    if table is None or not table.num_rows:
        return None
    t1, t2 = (table.column(c).to_numpy() for c in ("t1", "t2"))
    order = multikey_order(t1, t2)
    t1, t2 = t1[order], t2[order]
    new1 = np.concatenate(([True], t1[1:] != t1[:-1]))
    new2 = new1 | np.concatenate(([True], t2[1:] != t2[:-1]))
    del t1, t2
    run1, run2 = np.cumsum(new1) - 1, np.cumsum(new2) - 1
    same = np.bincount(run2)[run2] > 1
    if "more" in table.column_names:
        same |= pc.greater(table.column("more"), 0).to_numpy()[order]
    del run2
    many = np.bincount(run1[new2])[run1] > 1
    stays = np.flatnonzero(same | many | (run1 == 0) | (run1 == run1[-1]))
    del run1
    out = table.take(pa.array(order[stays]))
    for name, values in (("same", same), ("many", many), ("leads", new2)):
        out = out.append_column(name, pa.array(values[stays]))
    return out.append_column("bucket", pa.array(np.full(len(stays), TaskContext.get().partitionId(), np.int32)))


def compared(records: DataFrame, name: str) -> DataFrame:
    """``records`` (t1, t2, salt, ...) that share t1 with another, with three flags:

    same: another record has the same t1 and t2, or this one's ``more`` (if records have
    that column) is over 0, as it stands for several such; many: records with this t1 have
    several t2; leads: this is the first of the records with its t1 and t2.

    Sampled splitters over (t1, t2, salt) cut the records into even ranges, whatever the
    tokens; ``salt`` tells equal tokens apart, so that a hot token spreads over several
    buckets. ``records`` must be a stored table: it is read twice.
    """
    spark = records.sparkSession
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // BUCKET))
    extra = "same boolean, many boolean, leads boolean, bucket int"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    ordered = staged(records.repartitionByRange(n_buckets, "t1", "t2", "salt").mapInArrow(_sorted, f"{fields}, {extra}"), name)
    key = F.struct("t1", "t2")
    edges = (ordered.groupBy("bucket").agg(F.min(key), F.max(key), F.min_by("many", key), F.max_by("many", key))
             .orderBy("bucket").collect())  # one row per bucket
    mend = spark.createDataFrame(_mended([(b, tuple(a), tuple(z), *many) for b, a, z, *many in edges]),
                                 "bucket int, a1 long, a2 long, z1 long, z2 long, a_same boolean, z_same boolean, a_many boolean, z_many boolean")
    at_a, at_z = F.expr("t1 = a1 and t2 = a2"), F.expr("t1 = z1 and t2 = z2")
    return (ordered.join(F.broadcast(mend), "bucket")  # one row per bucket
            .withColumns({"same": F.col("same") | (at_a & F.col("a_same")) | (at_z & F.col("z_same")),
                          "many": F.col("many") | (F.expr("t1 = a1") & F.col("a_many")) | (F.expr("t1 = z1") & F.col("z_many")),
                          "leads": F.col("leads") & ~(at_a & F.col("a_same"))})
            .filter("same or many").select(*records.columns, "same", "many", "leads"))


def _mended(edges: list[tuple]) -> list[tuple]:
    """Per bucket its first and last tokens and what its neighbours say about the runs that touch them."""
    spread: dict[int, set] = {}  # of tokens at an edge: the second tokens seen there, None for more in between
    for _, a, z, many_a, many_z in edges:
        spread.setdefault(a[0], set()).update([a[1], None] if many_a else [a[1]])
        spread.setdefault(z[0], set()).update([z[1], None] if many_z else [z[1]])
    out = []
    for i, (bucket, a, z, _, _) in enumerate(edges):
        before = i > 0 and edges[i - 1][2] == a
        after = i + 1 < len(edges) and edges[i + 1][1] == z
        out.append((bucket, *a, *z, before, after, len(spread[a[0]]) > 1, len(spread[z[0]]) > 1))
    return out

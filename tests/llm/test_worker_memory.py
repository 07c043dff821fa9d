"""What tasks of the suffix dedup hold in a worker, and what they leave behind."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from shelfwise.llm import suffix_dedup, workers

_BUCKET = """
import numpy as np, pyarrow as pa
from types import SimpleNamespace
from shelfwise.llm import sorted_buckets as s
s.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3))
n, r = 200_000, np.random.default_rng(1)
t1 = r.integers(0, 1 << 60, n)
t1[5] = t1[7]
names = ["t1", "t2", "salt", "d", "n_bytes", "first"]
held = pa.RecordBatch.from_arrays([pa.array(t1), *(pa.array(r.integers(0, 9, n)) for _ in names[1:])], names=names)
out = pa.Table.from_batches(s._sorted(iter([held])))
twice = out.filter(pa.compute.equal(out["t1"], int(t1[5])))
assert out.num_rows == 4 and twice.num_rows == 2 and out["t1"].to_pylist() == sorted(out["t1"].to_pylist())
print(held.nbytes, pa.default_memory_pool().max_memory())
"""


def test_a_bucket_is_not_copied_whole():
    """In a process of its own, as Arrow's peak is that of the process. Only records that stay are copied."""
    run = subprocess.run([sys.executable, "-c", _BUCKET], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    bucket, most = map(int, run.stdout.split())
    assert most < bucket / 2


def test_arrays_of_run_records_follow_a_portion(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    letters = np.random.default_rng(2).choice(np.frombuffer(b"abcdefgh  ", np.uint8), (1000, 4000))
    texts = pa.array([row.tobytes().decode() for row in letters])
    ids = pa.array(np.arange(1000))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(np.full(1000, 4000)), texts], names=["d", "n_bytes", "text"])
    tracemalloc.start()
    records = sum(b.num_rows for b in suffix_dedup._run_records(400, 200, suffix_dedup._BYTES)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert records > 1000
    assert most < 40e6


def test_workers_forget_before_a_bucket_is_sorted(monkeypatch):
    from shelfwise.llm.sorted_buckets import _sorted

    forgotten = []
    monkeypatch.setitem(workers.CACHES, "other", lambda: forgotten.append("other"))
    assert list(_sorted(iter([]))) == []
    assert forgotten == ["other"]


def test_a_short_period_is_one_record(monkeypatch):
    """However long the text that repeats itself, in bytes and in words."""
    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    for unit, length in ((suffix_dedup._BYTES, 400), (suffix_dedup._WORDS, 51)):
        for times in (1000, 2000):
            text = "lorem " * times
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([len(text)]), pa.array([text])], names=["d", "n_bytes", "text"])
            made = pa.Table.from_batches(suffix_dedup._run_records(length, length // 2, unit)(iter([batch]))).to_pylist()
            assert len(made) < 10
            places = len(unit.of(text.encode())) // unit.width - length + 1
            assert sum(r["span"] + r["more"] + 1 for r in made) == places
            assert sum(r["more"] for r in made) > places - 100

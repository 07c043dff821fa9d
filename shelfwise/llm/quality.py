"""Quality by compression: which dictionary makes a text shorter?

Two zstandard dictionaries are built, one from texts labelled good and one from texts
labelled bad. A text is compressed whole with each and with none; the difference of
the two sizes per byte, beside how far the text compresses at all and the logarithm
of its length, goes through a logistic curve that is fitted on other labelled texts,
so that the score is a probability of "good".

What is fitted comes from a bounded sample of labelled rows (``Sample``); every
document is scored. Labels and ids are used for fitting only.

Cases: null and empty texts are scored as a text of no bytes. Ids labelled both ways
are no examples; of an id's several texts the smallest is one. Where one of the two
labels is missing, every score is the share of good labels (1 without any). Rows
repeat as in the input, other columns stay, result columns replace their namesakes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfwise.llm.workers import ship_code, slices

LEVEL = 3


@dataclass(frozen=True)
class Sample:
    """At most so many labelled texts, of at most so many bytes, reach the driver (7,000 x 32 KB at worst)."""

    per_dictionary: int = 1500
    calibration: int = 4000
    text_bytes: int = 32_000
    dictionary_bytes: int = 112_640


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # constant, then one for each feature, on features centred and scaled
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = (features(texts, self.good, self.bad) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -50, 50)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
    if not content:
        return zstandard.ZstdCompressor(**options)
    held = zstandard.ZstdCompressionDict(content)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(**options, dict_data=held)


@lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes) -> tuple:
    return _compressor(good), _compressor(bad), _compressor(b"")


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: (size by bad - size by good) / length, size without dictionary / length, log length."""
    packers = _compressors(good, bad)
    sizes = np.array([[len(p.compress(t)) for p in packers] for t in texts], float).reshape(-1, 3)
    length = np.maximum(np.fromiter(map(len, texts), float, len(texts)), 1)
    return np.column_stack([(sizes[:, 1] - sizes[:, 0]) / length, sizes[:, 2] / length, np.log(length)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += step * min(1, 4 / max(np.abs(step).max(), 1e-9))
    return w


def held_out(key: str = "doc_id") -> Column:
    """Ids that no fit may see: crc32 of the id as text divisible by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample: Sample = Sample()) -> Model:
    """A model from the ``labels`` of ids that are not held out.

    Ids are drawn in the order of their hash; one half of the ids may enter the
    dictionaries, the other half the calibration. Only drawn ids meet the documents.
    """
    hashed = F.xxhash64(key)
    known = (labels.filter(~held_out(key) & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key)
             .agg(F.min(label).alias("low"), F.max(label).alias("label")).filter("low = label").drop("low")
             .withColumn("calibrates", F.pmod(hashed, F.lit(2)) == 1))
    drawn = None
    for role, most in ((F.expr("not calibrates and label = 1"), sample.per_dictionary),
                       (F.expr("not calibrates and label = 0"), sample.per_dictionary),
                       (F.col("calibrates"), sample.calibration)):
        part = known.filter(role).orderBy(hashed, key).limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = (docs.select(key, text).filter(F.octet_length(text).between(1, sample.text_bytes))
            .join(F.broadcast(drawn), key)  # the sample's bound
            .groupBy(key, "label", "calibrates").agg(F.min(text).alias("text")).orderBy(key).collect())
    examples = [(r["text"].encode(), r["label"], r["calibrates"]) for r in rows]
    good, bad = (_dictionary([t for t, y, c in examples if y == kind and not c], sample.dictionary_bytes) for kind in (1, 0))
    fitted = [(t, y) for t, y, c in examples if c]
    y = np.array([y for _, y in fitted], float)
    if not (good and bad) or len(set(y)) < 2:
        share = float(np.mean([y for _, y, _ in examples])) if examples else 1.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0), (0.0,) * 3, (1.0,) * 3)
    x = features([t for t, _ in fitted], good, bad)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(good, bad, tuple(_logistic((x - centre) / scale, y)), tuple(centre), tuple(scale))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few texts for the trainer: their own bytes serve
        return b"".join(texts)[-size:]


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def with_scores(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on)."""
    ship_code(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shipped = pickle.dumps(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            scores = _loaded(shipped).scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(score, schema)

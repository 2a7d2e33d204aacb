"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, unused, worker_cache

#: Labelled rows that a fit takes at most, those with the smallest hash of doc_id.
FIT_ROWS = 20_000
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,", b"!?", b":;", b"\"'`", b"()[]{}<>", b"*&%$#@^~", b"|\\/_+=-", bytes(range(128, 256))]
_WEIGHTS = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _WEIGHTS[list(_c), _i] = 1.0
N_STATS = len(_CLASSES) + 13


def stats(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty. Nothing but the text goes in."""
    data = (text or "").encode()
    n = max(len(data), 1)
    shares = (np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _WEIGHTS / n).tolist()
    split = data.split()
    w, seen = max(len(split), 1), Counter(split)
    common = seen.most_common(1)[0][1] if seen else 0
    lines = [x for x in data.split(b"\n") if x]
    lengths = list(map(len, split))
    long = max(lengths, default=0)
    return [
        *shares, np.log1p(len(data)), np.log1p(len(split)), len(data) / w, np.log1p(long), len(seen) / w, common / w, np.log1p(len(lines)), np.log1p(len(data) / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), sum(1 for x in seen.values() if x == 1) / w, sum(x <= 3 for x in lengths) / w, sum(x >= 12 for x in lengths) / w, float(not split),
    ]


@dataclass
class Model:
    """What scoring needs; a few hundred KB whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    knots_x: np.ndarray
    knots_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, whose products approximate a Gaussian kernel of the standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / max(len(self.phases), 1))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots_x, self.knots_y), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to y over x (pool adjacent violators); ties in x are pooled first."""
    values, at = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for v, s, k in zip(values, np.bincount(at, weights=y), np.bincount(at), strict=True):
        blocks.append([s, k, v * k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _stats_of(docs: DataFrame, keep: str, kind: str, text: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the statistics of each text."""
    names = keep.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in slices(batches):
            x = [stats(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    return docs.select(*names, F.col(text).alias("text")).mapInArrow(run, f"{kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, waves: int = 256, ridge: float = 1e-3, width: float = 1.5, seed: int = 7) -> Model:
    """Learn from the labelled rows whose remainder isn't 2, at most ``fit_rows`` of them, chosen by a hash of doc_id.

    Three quarters of them give the ridge weights, the rest the calibration. Each partition sums its own normal equations; the
    sums of at most 8 partitions come to the driver. Rows without doc_id or label are left out, and of several labels of one
    document the smallest counts; of rows that share a doc_id the one with the smallest statistics is taken. Without labels every score is 0.5; with labels of one kind only, that kind.
    """
    taken = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    taken = taken.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded, hence the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    each = _stats_of(rows, "doc_id, y, calibrate", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, calibrate boolean")
    x = cut(each.groupBy("doc_id", "y", "calibrate").agg(F.min("x").alias("x")).repartition(8))
    moments = x.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not moments:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, 0)), np.zeros(0), np.zeros(1), np.array([0.0]), np.array([0.5]))
    rng = np.random.default_rng(seed)
    mean, scale = np.array([r["m"] for r in moments]), np.array([r["s"] or 0.0 for r in moments])
    scale[scale < 1e-9] = 1.0
    model = Model(mean, scale, rng.normal(size=(N_STATS, waves)) / (width * np.sqrt(N_STATS)), rng.uniform(0, 2 * np.pi, waves), np.zeros(0), np.array([0.0]), np.array([0.5]))

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = 0.0, 0.0
        for frame in frames:
            if len(frame):
                z, y = model.features(np.vstack(frame["x"].to_numpy())), frame["y"].to_numpy()
                a, b = a + z.T @ z, b + z.T @ y
        if not np.isscalar(a):
            yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    sums = x.filter("not calibrate").mapInPandas(equations, "a binary, b binary").collect()
    k = waves + 1
    a, b = np.zeros((k, k)), np.zeros(k)
    for r in sums:
        a, b = a + np.frombuffer(r["a"]).reshape(k, k), b + np.frombuffer(r["b"])
    model.ridge = np.linalg.solve(a + ridge * max(np.trace(a) / k, 1e-9) * np.eye(k), b)
    held = x.filter("calibrate").select("x", "y").toPandas()  # a quarter of fit_rows at most
    if not len(held):
        held = x.select("x", "y").toPandas()
    model.knots_x, model.knots_y = isotonic(model.raw(np.vstack(held["x"].to_numpy())), held["y"].to_numpy())
    return model


def scorer(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score, 0 to 1, of each row's whole text; a null text counts as empty, a long one is worked on alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        worker_cache()
        return pd.Series(sent.value.score(np.array([stats(t) for t in texts]).reshape(-1, N_STATS)))

    return scored(docs[text])


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on, else 0).

    Where ``docs`` has a column of one of those names, that stays and the new one has an underscore behind its name. Null and empty
    texts have a score too; repeated rows have one each; an empty table gives no rows.
    """
    a, b = unused(docs.columns, "score", "predicted")
    return docs.withColumn(a, scorer(docs, model, text)).withColumn(b, (F.col(a) >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns unchanged and whatever their names."""
    return docs.filter(scorer(docs, model, text) >= threshold)


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`score` of all ``documents`` by a model of the ``labels`` that aren't held out; a null doc_id isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")

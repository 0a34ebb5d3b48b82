"""A classifier of hashed n-grams with one hidden layer, trained over the partitions of a table, several folds at once.

Parameters are broadcast for a step; each task sums the gradient of its rows, sums of tasks are added up in two levels,
and the driver moves the parameters. Several models that differ in which rows they train on (the folds of a
cross-validation) stand side by side: one pass over the rows gives the gradients and validation counts of all.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import classify
from weftline.operators.sums import SLICE, SUMS, _added
from weftline.session import cut

BUCKETS, HIDDEN, RATE, STEPS = 1 << 14, 8, 0.05, 4
#: Rows of a product.
ROWS = 256
#: What a model does with a row.
TRAIN, VAL, TEST, UNUSED = range(4)


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words, pairs of words and character trigrams, and roots of their counts at length 1."""
    words = [w.encode() for w in (text or "").lower().split()]
    hashes = [zlib.crc32(w) for w in words]
    hashes += [zlib.crc32(b" " + second, first) for first, second in zip(hashes, words[1:])]  # of both words with a blank
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    grams = (codes[:-2] * 1_000_003 + codes[1:-1] * 8191 + codes[2:]) * 2_654_435_761 >> 7
    counts = np.bincount(np.concatenate([np.array(hashes, dtype=np.int64), grams]) % buckets, minlength=buckets)
    found = np.flatnonzero(counts)
    values = np.sqrt(counts[found])
    return found.astype(np.int32), (values / max(np.sqrt((values**2).sum()), 1e-12)).astype(np.float32)


def featured(rows: DataFrame, label: str, labels: list[str], keep: list[str], text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(*keep, y, at, x)``: the label's number (-1 of others) and the features of each row's text."""
    y = F.coalesce(F.array_position(F.array(*map(F.lit, labels)), F.col(label).cast("string")) - 1, F.lit(-1)).cast("int")
    own = rows.select(*keep, y.alias("y"), F.col(text).cast("string").alias("__text"))
    names = own.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", at array<int>, x array<float>"

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                at, x = zip(*(features(t.as_py(), buckets) for t in some.column(some.num_columns - 1)))
                ends = np.cumsum([0, *map(len, at)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, np.concatenate(part)) for part in (at, x)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *lists], names=[*names, "at", "x"])

    return own.mapInArrow(of_partition, schema)


@dataclasses.dataclass
class Models:
    """Parameters of models side by side: buckets to hidden, hidden to labels, and what is added to both."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, models: int, labels: int, buckets: int = BUCKETS, hidden: int = HIDDEN, seed: int = 1) -> Models:
        """All models begin alike."""
        rng = np.random.default_rng(seed)
        w, v = rng.standard_normal((buckets, hidden)) * 0.3, rng.standard_normal((hidden, labels)) * hidden**-0.5
        return cls(*(np.repeat(x[None], models, axis=0).astype(np.float32) for x in (w, np.zeros(hidden), v, np.zeros(labels))))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.w, self.b, self.v, self.c)]).astype(np.float64)

    def of(self, flat: np.ndarray) -> Models:
        """Parameters of the same shapes from one row of numbers."""
        out, at = [], 0
        for x in (self.w, self.b, self.v, self.c):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Models(*out)

    def probabilities(self, at: np.ndarray, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets that rows have, rows by these, and hidden values and probabilities (models, rows, ...), by one product for
        all models. A row has a bucket once."""
        k, buckets, hidden = self.w.shape
        there = np.zeros(buckets, dtype=bool)
        there[at] = True
        used, place = np.flatnonzero(there), np.cumsum(there) - 1
        full = np.zeros((len(begins) - 1, len(used)), np.float32)
        full[np.repeat(np.arange(len(full)), np.diff(begins)), place[at]] = x
        sums = full @ self.w[:, used].transpose(1, 0, 2).reshape(len(used), k * hidden)
        values = np.tanh(sums.reshape(-1, k, hidden).transpose(1, 0, 2) + self.b[:, None])
        z = values @ self.v + self.c[:, None]
        p = np.exp(z - z.max(axis=2, keepdims=True))
        return used, full, values, p / p.sum(axis=2, keepdims=True)


def batch_sums(models: Models, y: np.ndarray, roles: np.ndarray, weights: np.ndarray, at: np.ndarray, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Gradient of the weighted log loss over TRAIN rows of all models, and behind it, for each model, that loss, its weight,
    and a table of VAL rows by label and prediction. ``roles`` are rows by models, ``weights`` models by labels."""
    (k, buckets, hidden), labels = models.w.shape, models.c.shape[1]
    by_bucket, grads, more = np.zeros((buckets, k * hidden)), [np.zeros(p.shape) for p in (models.b, models.v, models.c)], np.zeros((k, 2 + labels * labels))
    for first in range(0, len(y), ROWS):
        some, ends = slice(first, first + ROWS), begins[first : first + ROWS + 1]
        own, inside = y[some], slice(ends[0], ends[-1])
        used, full, values, p = models.probabilities(at[inside], x[inside], ends - ends[0])
        each, d_hidden = np.arange(len(own)), np.zeros((len(own), k, hidden), np.float32)
        for m in range(k):
            train, val = (roles[some, m] == TRAIN) & (own >= 0), (roles[some, m] == VAL) & (own >= 0)
            weight = np.where(train, weights[m][own], 0)
            more[m, 0] -= (weight * np.log(np.maximum(p[m, each, own], 1e-30))).sum()
            more[m, 1] += weight.sum()
            more[m, 2:] += np.bincount(own[val] * labels + p[m, val].argmax(axis=1), minlength=labels * labels)
            d = p[m].copy()
            d[each, own] -= 1
            d *= weight[:, None]
            d_hidden[:, m] = (d @ models.v[m].T) * (1 - values[m] ** 2)
            for grad, part in zip(grads, (d_hidden[:, m].sum(axis=0), values[m].T @ d, d.sum(axis=0))):
                grad[m] += part
        by_bucket[used] += full.T @ d_hidden.reshape(len(own), -1)
    w = by_bucket.reshape(buckets, k, hidden).transpose(1, 0, 2)
    return np.concatenate([w.ravel(), *(g.ravel() for g in grads), more.ravel()])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y = batch.column("y").to_numpy()
    at, x = batch.column("at"), batch.column("x").flatten().to_numpy()
    begins = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy())))
    roles = batch.column("roles").flatten().to_numpy().reshape(len(y), -1)
    return y, roles, at.flatten().to_numpy(), x, begins


def total(rows: DataFrame, models: Models, weights: np.ndarray) -> np.ndarray:
    """``batch_sums`` over a table ``(y, roles, at, x)``, added up by slices in two levels of tasks."""
    shared = rows.sparkSession.sparkContext.broadcast((models, weights))
    groups = max(1, int(rows.rdd.getNumPartitions() ** 0.5))

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        sums = None
        for batch in batches:
            part = batch_sums(own, *(lambda y, roles, *rest: (y, roles, weight, *rest))(*_columns(batch)))
            sums = part if sums is None else sums + part
        if sums is not None:
            n = -(-len(sums) // SLICE)
            group = TaskContext.get().partitionId() % groups
            for k in range(n):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([k], pa.int32()), pa.array([sums[k * SLICE : (k + 1) * SLICE].tobytes()])], names=["group", "slice", "data"])

    sums = rows.select("y", "roles", "at", "x").mapInArrow(of_partition, SUMS)
    if groups > 1:
        sums = sums.repartition("group", "slice").mapInArrow(_added, SUMS)
    done = sums.withColumn("group", F.lit(0)).repartition("slice").mapInArrow(_added, SUMS).toArrow().sort_by("slice")
    size = models.flat().size + models.c.shape[0] * (2 + models.c.shape[1] ** 2)
    shared.unpersist()
    return np.concatenate([np.frombuffer(x) for x in done["data"].to_pylist()]) if done.num_rows else np.zeros(size)


def macro_f1(matrix: np.ndarray) -> float:
    """The mean over labels of F1, 0 where nothing was predicted or there."""
    hit, both = np.diag(matrix), matrix.sum(axis=0) + matrix.sum(axis=1)
    return float(np.where(both > 0, 2 * hit / np.maximum(both, 1), 0).mean())


@dataclasses.dataclass
class Trained:
    best: Models  # each model at its epoch of best macro-F1 on VAL rows; of equal ones the first
    best_epoch: list[int]
    history: list[list[dict]]  # of each model, by epoch: loss before the epoch's last step and macro-F1


class Descent:
    """Adam on all models at once; a step is one pass over the rows."""

    def __init__(self, models: Models, rate: float = RATE) -> None:
        self.models, self.rate, self.step = models, rate, 0
        self.m = self.v = 0.0

    def pass_over(self, rows: DataFrame, weights: np.ndarray, move: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(mean loss of each model, VAL counts), both of the parameters before this step."""
        k, labels = self.models.c.shape
        sums, flat = total(rows, self.models, weights), self.models.flat()
        more = sums[flat.size :].reshape(k, -1)
        if move:
            # each model's gradient is a mean over its own rows
            scale = [np.repeat(1 / np.maximum(more[:, 1], 1e-12), x[0].size) for x in (self.models.w, self.models.b, self.models.v, self.models.c)]
            g = sums[: flat.size] * np.concatenate(scale)
            self.step += 1
            self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g**2
            flat -= self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.99**self.step)) + 1e-8)
            self.models = self.models.of(flat)
        return more[:, 0] / np.maximum(more[:, 1], 1e-12), more[:, 2:].reshape(k, labels, labels)


def balanced(rows: DataFrame, models: int, labels: int) -> np.ndarray:
    """Weights of labels for each model: its TRAIN rows over (labels that it has times rows of the label)."""
    counts = np.zeros((models, labels))
    for r in rows.filter("y >= 0").select("y", F.posexplode("roles").alias("m", "role")).filter(F.col("role") == TRAIN).groupBy("m", "y").agg(F.count("*").alias("n")).collect():  # models times labels
        counts[r["m"], r["y"]] = r["n"]
    there = (counts > 0).sum(axis=1, keepdims=True)
    return np.where(counts > 0, counts.sum(axis=1, keepdims=True) / np.maximum(there * counts, 1e-12), 0)


def train(rows: DataFrame, models: int, labels: int, epochs: int = 4, steps: int = STEPS, buckets: int = BUCKETS, hidden: int = HIDDEN) -> Trained:
    """Models fitted on ``rows(y, roles, at, x)``, each judged on its VAL rows after every epoch of ``steps`` passes."""
    weights, descent = balanced(rows, models, labels), Descent(Models.fresh(models, labels, buckets, hidden))
    best, best_epoch, score = descent.models, [0] * models, [-1.0] * models
    history: list[list[dict]] = [[] for _ in range(models)]
    for pass_ in range(epochs * steps + 1):
        epoch, before = divmod(pass_, steps)[0], descent.models
        loss, counts = descent.pass_over(rows, weights, move=pass_ < epochs * steps)
        if pass_ and pass_ % steps == 0:
            for m in range(models):
                now = macro_f1(counts[m])
                history[m].append({"epoch": epoch, "loss": float(loss[m]), "val_macro_f1": now})
                if now > score[m]:
                    score[m], best_epoch[m] = now, epoch
                    parts = [x.copy() for x in (best.w, best.b, best.v, best.c)]
                    for part, new in zip(parts, (before.w, before.b, before.v, before.c)):
                        part[m] = new[m]
                    best = Models(*parts)
    return Trained(best, best_epoch, history)


def predictions(rows: DataFrame, models: Models, keep: list[str], labels: list[str], role: int = TEST) -> DataFrame:
    """``(*keep, fold, y_true, y_pred)`` of the rows that have ``role`` for a model, by that model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    own = rows.select(*keep, "y", "roles", "at", "x")
    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep) + ", fold int, y_true string, y_pred string"

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*labels, None], dtype=object)  # of others (-1) nothing is known
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                y, roles, at, x, begins = _columns(some)
                p = shared.value.probabilities(at, x, begins)[-1]
                for m in range(roles.shape[1]):
                    rows_ = np.flatnonzero(roles[:, m] == role)
                    if len(rows_):
                        said = p[m, rows_].argmax(axis=1)
                        yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(rows_)) for c in keep), pa.array(np.full(len(rows_), m, np.int32)), pa.array(names[y[rows_]], pa.string()), pa.array(names[said], pa.string())], names=[*keep, "fold", "y_true", "y_pred"])

    return own.mapInArrow(of_partition, schema)


def cross_validate(rows: DataFrame, key: str, label: str, labels: list[str], k: int = 5, epochs: int = 4, steps: int = STEPS, text: str = "text", seed: int = 42, buckets: int = BUCKETS, hidden: int = HIDDEN) -> tuple[DataFrame, Trained]:
    """Predictions ``(key, fold, y_true, y_pred)`` of every row by the model of its test fold, and the models.

    All folds are fitted together: a row's features are read once a step, whatever the number of folds.
    """
    dealt = classify.nested_folds(rows.select(key, label), key, label, k, seed=seed)
    role = F.when(F.col("part") == "train", TRAIN).when(F.col("part") == "val", VAL).otherwise(TEST)
    roles = dealt.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", role.alias("r")))), lambda x: x["r"]).alias("roles"))  # k numbers a row
    spark = rows.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ready = cut(featured(rows.join(roles, key).repartition(parts, key), label, labels, [key, "roles"], text, buckets))
    done = train(ready, k, len(labels), epochs, steps, buckets, hidden)
    return predictions(ready, done.best, [key], labels), done


class Network:
    """A ``Trainer`` of ``training.fine_tune``: one model; an epoch is ``steps`` passes over the rows it is given."""

    def __init__(self, label: str, labels: list[str], text: str = "text", steps: int = STEPS, buckets: int = BUCKETS, hidden: int = HIDDEN) -> None:
        self.label, self.labels, self.text, self.steps, self.buckets = label, labels, text, steps, buckets
        self.descent = Descent(Models.fresh(1, len(labels), buckets, hidden))
        self.kept = self.descent.models
        self._ready: tuple[DataFrame, DataFrame] | None = None
        self._asked: tuple[DataFrame, DataFrame] | None = None

    def _rows(self, rows: DataFrame, role: int, keep: list[str]) -> DataFrame:
        return featured(rows.withColumn("roles", F.array(F.lit(role))), self.label, self.labels, [*keep, "roles"], self.text, self.buckets)

    def epoch(self, rows: DataFrame, weights: dict[str, float]) -> float:
        if self._ready is None or self._ready[0] is not rows:
            self._ready = (rows, cut(self._rows(rows, TRAIN, [])))
        own, loss = np.array([[weights.get(x, 0.0) for x in self.labels]]), 0.0
        for _ in range(self.steps):
            loss = float(self.descent.pass_over(self._ready[1], own)[0][0])
        return loss

    def predict(self, rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c not in ("y_true", "y_pred", "fold", "roles", "y", "at", "x")]
        if self._asked is None or self._asked[0] is not rows:  # the same rows are asked after every epoch
            self._asked = (rows, cut(self._rows(rows, TEST, keep)))
        return predictions(self._asked[1], self.descent.models, keep, self.labels).drop("fold", "y_true")

    def keep(self) -> None:
        self.kept = self.descent.models

    def restore(self) -> None:
        self.descent.models = self.kept

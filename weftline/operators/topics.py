"""Themes by seeded non-negative factorisation: chunks as sums of topics, each label with a topic of its own.

Counts of words by chunk are taken apart into weights of chunks and words of topics by multiplicative updates, whose loss
never rises. A chunk's weights are updated where its row is; only sums by topic and word move.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.sums import SLICE, SUMS, _added
from weftline.operators.vectors import WORDS_AT_ONCE, words_of
from weftline.session import cut, remove, written

#: Topics besides those of the labels, rounds, and words of a label's seed: those that begin with its first letters.
FREE, ROUNDS, STEM = 6, 20, 4
#: What a seed's words weigh in their own topic at first, and the least that a denominator may be.
SEEDED, TINY = 20.0, 1e-12
#: Rounds between two in which chunks are written with their weights, chunks whose words are counted at a time, and
#: words of chunks that meet their topics at a time (what a processor's cache holds).
KEPT, ROWS, PLACES = 5, 4096, 1 << 13


@dataclasses.dataclass
class Topics:
    words: list[str]
    labels: list[str]
    h: np.ndarray  # topics by words, the labels' first
    losses: list[float]
    rows: DataFrame  # keys and ``w``, the chunk's weights


def vocabulary(counts: DataFrame, most: int = WORDS_AT_ONCE) -> list[str]:
    """Words of two chunks or more; where these are more than ``most``, the number of chunks asked for doubles."""
    spread = cut(counts.groupBy("word").agg(F.count("*").alias("chunks")))
    least = 2
    while spread.filter(F.col("chunks") >= least).count() > most:
        least *= 2
    return [r["word"] for r in spread.filter(F.col("chunks") >= least).orderBy("word").collect()]


def seeds(words: list[str], labels: list[str], free: int = FREE, seed: int = 3) -> np.ndarray:
    """Words of topics at first: a label's own words weigh more in its topic, all others are near one."""
    h = np.random.default_rng(seed).uniform(0.5, 1.5, (len(labels) + free, len(words)))
    for k, label in enumerate(labels):
        h[k, [w.startswith(label.strip().lower()[:STEM]) for w in words]] *= SEEDED
    return h / np.maximum(h.sum(axis=1, keepdims=True), TINY)


def chunk_update(w: np.ndarray, v_h: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """New weights of chunks, from their counts times topics and the topics' products."""
    return w * v_h / np.maximum(w @ gram, TINY)


def word_update(h: np.ndarray, w_v: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """New words of topics, from the weights' sums of counts and the weights' products."""
    return h * w_v / np.maximum(gram @ h, TINY)


def factorise(chunks: DataFrame, keys: list[str], labels: list[str], free: int = FREE, rounds: int = ROUNDS, text: str = "text") -> Topics:
    """Topics of ``chunks(*keys, text)``, whose keys tell rows apart; each round is one pass over counts of words.

    Counts are made where a chunk's row is. Weights are written every ``KEPT`` rounds; in between a pass makes them again
    from those last written and the topics since. What the driver holds is topics by words, of a checked number of words. Chunks without a known word have
    weights of zero.
    """
    spark = chunks.sparkSession
    worded = chunks.select(*keys, words_of(F.coalesce(text, F.lit(""))).alias("words"))
    words = vocabulary(worded.select(F.explode(F.array_distinct("words")).alias("word")))
    h, k, n = seeds(words, labels, free), len(labels) + free, len(words)
    shared = spark.sparkContext.broadcast({word: at for at, word in enumerate(words)})
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in worded.schema.fields[:-1])
    names, old, losses, since = [*keys, "at", "x", "w"], None, [], []

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                lists = some.column("words")
                coded = lists.flatten().dictionary_encode()
                number = np.array([numbers.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
                owner = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())[number >= 0]
                both, times = np.unique(owner * max(1, n) + number[number >= 0], return_counts=True)
                owner, number = np.divmod(both, max(1, n))
                each = np.bincount(owner, minlength=some.num_rows)
                has, ends = pa.array(each > 0), np.concatenate([[0], np.cumsum(each[each > 0])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, number.astype(np.int32)), pa.ListArray.from_arrays(ends, times.astype(float))
                ones = pa.ListArray.from_arrays(np.arange(0, k * len(ends), k, dtype=np.int32), np.ones(k * (len(ends) - 1)))
                yield pa.RecordBatch.from_arrays([*(some.column(c).filter(has) for c in keys), *lists, ones], names=names)

    state = worded.mapInArrow(counted, f"{own}, at array<int>, x array<double>, w array<double>")

    def of_partition(batches: Iterator[pa.RecordBatch], since: list[np.ndarray], keep: bool) -> Iterator[pa.RecordBatch]:
        sums, squares, norm, topics = np.zeros(n * k), np.zeros((k, k)), 0.0, np.arange(k)
        by_word, grams = np.ascontiguousarray(np.concatenate(since).T), [h @ h.T for h in since]  # a word's weights stand together
        kinds_of, kinds = None, [pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            if not batch.num_rows:
                continue
            at, x = batch.column("at"), batch.column("x").flatten().to_numpy()
            each, of = at.value_lengths().to_numpy(), at.flatten().to_numpy()
            w = batch.column("w").flatten().to_numpy().reshape(-1, k)
            ends, made = np.concatenate([[0], np.cumsum(each)]), []
            edges = np.unique(np.r_[0, np.searchsorted(ends[:-1], np.arange(PLACES, ends[-1], PLACES)), batch.num_rows])
            for a, b in zip(edges[:-1], edges[1:]):
                word, times, own = of[ends[a] : ends[b]], x[ends[a] : ends[b], None], w[a:b]
                v_h = np.add.reduceat(by_word[word] * times, ends[a:b] - ends[a])  # of all rounds
                for r, gram in enumerate(grams):
                    own = chunk_update(own, v_h[:, r * k : (r + 1) * k], gram)
                np.add.at(sums, (word[:, None] * np.int64(k) + topics).ravel(), (np.repeat(own, each[a:b], axis=0) * times).ravel())
                made.append(own)
            w = np.concatenate(made)
            squares += w.T @ w
            norm += float((x**2).sum())
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), np.ascontiguousarray(w).ravel())
            kinds_of = [*(batch.column(c).type for c in names[:-1]), lists.type]
            if keep:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), lists, *(pa.nulls(batch.num_rows, t) for t in kinds)], names=[*names, "group", "slice", "data"])
        if kinds_of:
            flat = np.concatenate([sums.reshape(n, k).T.ravel(), squares.ravel(), [norm]])
            parts = [flat[i : i + SLICE].tobytes() for i in range(0, len(flat), SLICE)]
            none = [pa.nulls(len(parts), t) for t in kinds_of]
            yield pa.RecordBatch.from_arrays([*none, pa.array([0] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=[*names, "group", "slice", "data"])

    kept = f"{own}, at array<int>, x array<double>, w array<double>, {SUMS}"
    for number in range(rounds):
        since, keep = [*since, h], number % KEPT == 0 or number == rounds - 1
        # a task's sums are as long as there are words, so tasks are as many as cores
        rows = state.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(lambda batches, since=since, keep=keep: of_partition(batches, since, keep), kept)
        if keep:
            path, rows = written(rows)
            if old:
                remove(spark, old)
            old, state, since = path, rows.filter("slice is null").select(*names), []
        done = rows.filter("slice is not null").select("group", "slice", "data").repartition("slice").mapInArrow(_added, SUMS).toArrow().sort_by("slice")
        if not done.num_rows:
            break
        flat = np.concatenate([np.frombuffer(x) for x in done["data"].to_pylist()])
        w_v, gram, norm = flat[: k * n].reshape(k, n), flat[k * n : -1].reshape(k, k), flat[-1]
        h = word_update(h, w_v, gram)
        losses.append(float(norm - 2 * (h * w_v).sum() + (gram * (h @ h.T)).sum()))
    return Topics(words, labels, h, losses, state.select(*keys, "w"))


def score(topics: Topics, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Every chunk against every label, in long form: the share of a chunk's topics that is the label's (0 without any).

    Labels are scored by how much of a chunk's words their topics explain.
    """
    mass = topics.h.sum(axis=1)
    shares = F.transform(F.arrays_zip("w", F.array(*map(F.lit, mass.tolist())).alias("m")), lambda x: x["w"] * x["m"])
    rows = chunks.join(topics.rows.select(*keys, shares.alias("__s")), keys, "left")
    total = F.aggregate("__s", F.lit(0.0), lambda s, x: s + x)
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("theme"), F.coalesce(F.when(total > 0, F.get("__s", k) / total), F.lit(0.0)).alias("score")) for k, label in enumerate(topics.labels)]))
    return rows.withColumn("__x", each).select(*chunks.columns, "__x.theme", "__x.score")

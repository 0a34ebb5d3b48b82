"""Logistic regression on terms of texts where the terms are too many for one process.

Terms are dealt to shards by their name, each with the texts that hold it, and stay there: neither the vocabulary nor a
weight for each term is ever in one place. The weights of a fit are sums of the texts' features, so a step is known by one
number for each text and label: these are sent to the shards, which answer with the texts' products.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.sums import SLICE, SUMS, _added
from weftline.session import cut

#: Characters of the texts that are taken apart at a time, characters of all texts for each shard, and places of terms
#: in texts that a row of a shard holds (more only for one term).
BLOCK, SHARD, PLACES = 2_000_000, 4_000_000, 1_000_000
#: Kinds of terms: words with pairs of words, and characters within words.
WORDS, CHARS = 0, 1
#: Steps of a fit at most, what ends it, steps that the next one is built of, and looks along a step.
STEPS, TOLERANCE, MEMORY, LOOKS = 50, 1e-4, 10, 40
GRAMS = (3, 4, 5)

MESSAGE = "kind int, shard int, terms binary, n binary, docs binary, times binary"
HELD = "kind int, shard int, terms binary, idf binary, n binary, docs binary, times binary"


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``__doc`` from 0 on without gaps, as a table, and their number; parts of the table count for themselves."""
    rows = cut(rows.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one a part
    before, firsts = 0, []
    for p in sorted(counts):
        firsts.append((p, before))
        before += counts[p]
    first = F.broadcast(rows.sparkSession.createDataFrame(firsts or [(-1, 0)], "__part long, __first long"))
    return rows.join(first, part == F.col("__part")).withColumn("__doc", (F.col("__first") + F.col("__id") % (1 << 33)).cast("int")).drop("__id", "__part", "__first"), before


def _of_words(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and the term, text and number of each place, of lists of words: the words and pairs of neighbours."""
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    same = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, pair = np.unique(at[same] * len(words) + at[same + 1], return_inverse=True)
    terms = words + [f"{words[a]} {words[b]}" for a, b in zip(*(x.tolist() for x in divmod(pairs, max(1, len(words)))))]
    return terms, np.concatenate([at, len(words) + pair]), np.concatenate([doc, doc[same]]), np.ones(len(at) + len(same), np.int64)


def _of_chars(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The same of characters within words; each word is taken apart once, and counts for the texts that hold it."""
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    both, times = np.unique(doc * max(1, len(words)) + at, return_counts=True)
    doc, at = divmod(both, max(1, len(words)))
    table: dict[str, int] = {}
    grams, ends = [], [0]
    for word in words:
        s = f" {word} "
        grams += [table.setdefault(s[i : i + n], len(table)) for n in GRAMS for i in range(max(1, len(s) + 1 - n))]
        ends.append(len(grams))
    grams, ends = np.array(grams, np.int64), np.array(ends)
    each = np.diff(ends)[at]
    # the places of a word's grams in ``grams``, for each text that holds it
    places = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(ends[at], each)
    return list(table), grams[places], np.repeat(doc, each), np.repeat(times, each)


def _messages(kind: int, found: tuple[list[str], np.ndarray, np.ndarray, np.ndarray], docs: np.ndarray, shards: int) -> Iterator[tuple]:
    """What each shard gets of a block of texts: its terms, and of each the texts that hold it and how often."""
    terms, term, doc, times = found
    if not terms:
        return
    shard = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % shards for t in terms])
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    key = place[term] * len(docs) + doc
    by = np.argsort(key, kind="stable")
    key, times = key[by], times[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.add.reduceat(times, first)
    term, doc = divmod(key[first], len(docs))
    n = np.bincount(term, minlength=len(terms))
    ends, edges = np.concatenate([[0], np.cumsum(n)]), np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.unique(shard).tolist():
        a, b = edges[s], edges[s + 1]
        own = "\n".join(terms[k] for k in order[a:b]).encode("utf-8", "surrogatepass")
        yield kind, s, own, n[a:b].astype(np.int32).tobytes(), docs[doc[ends[a] : ends[b]]].astype(np.int32).tobytes(), times[ends[a] : ends[b]].astype(np.uint32).tobytes()


def dealt(rows: DataFrame, text: str, shards: int) -> DataFrame:
    """``MESSAGE``s of all ``rows(__doc, text)``, a few for each block of texts and shard."""
    lower = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = RegexTokenizer(inputCol="__text", outputCol="__all", pattern=r"\b\w\w+\b", gaps=False).transform(rows.select("__doc", lower.alias("__text")))
    ready = StopWordsRemover(inputCol="__all", outputCol="__words").transform(words).select("__doc", "__words", F.split(F.lower("__text"), r"\s+").alias("__chars"), F.length("__text").alias("__n"))

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.cumsum(batch.column("__n").to_numpy()) // BLOCK
            firsts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if batch.num_rows else []
            for a, b in zip(firsts, [*firsts[1:], batch.num_rows]):
                docs = batch.column("__doc").slice(a, b - a).to_numpy()
                for kind, found in ((WORDS, _of_words), (CHARS, _of_chars)):
                    for message in _messages(kind, found(batch.column("__words" if kind == WORDS else "__chars").slice(a, b - a)), docs, shards):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(message, KINDS)], names=NAMES)

    return ready.mapInArrow(of_partition, MESSAGE)


NAMES, KINDS = ["kind", "shard", "terms", "n", "docs", "times"], [pa.int32(), pa.int32(), *[pa.binary()] * 4]


def _met(table: pa.Table, numbers: dict[str, int] | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a shard's messages, and the term, text and number of each place, by terms. Of ``numbers``, others are left out."""
    grow = numbers is None
    numbers = {} if grow else numbers
    own, n, docs, times = [], [], [], []
    for names, count, doc, time in zip(*(table.column(c).to_pylist() for c in NAMES[2:])):
        names = names.decode("utf-8", "surrogatepass").split("\n")
        own.append(np.array([numbers.setdefault(t, len(numbers)) if grow else numbers.get(t, -1) for t in names]))
        n.append(np.frombuffer(count, np.int32))
        docs.append(np.frombuffer(doc, np.int32))
        times.append(np.frombuffer(time, np.uint32))
    term, doc, times = np.repeat(np.concatenate(own), np.concatenate(n)), np.concatenate(docs), np.concatenate(times)
    if not grow:
        known = term >= 0
        term, doc, times = term[known], doc[known], times[known]
    order = np.argsort(term, kind="stable")
    return list(numbers), term[order], doc[order], times[order]


def held(messages: DataFrame, n: int, least: tuple[float, float]) -> DataFrame:
    """``HELD``: the terms of each shard in ``least`` texts or more (by kind; below 1 a share of all ``n``), with their rarity
    and the texts that hold them, in rows of a bounded number of places."""

    def of_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, shard = (k.as_py() for k in key)
        terms, term, doc, times = _met(table)
        count = np.bincount(term, minlength=len(terms))
        keep = np.flatnonzero(count >= (least[kind] if least[kind] >= 1 else least[kind] * n))
        stays = np.isin(term, keep)
        doc, times, count = doc[stays], times[stays], count[keep]
        ends, idf, out, first = np.concatenate([[0], np.cumsum(count)]), np.log((n + 1) / (count + 1)), [], 0
        while first < len(keep):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + PLACES, "right")) - 1)
            some = times[ends[first] : ends[last]]
            names = "\n".join(terms[k] for k in keep[first:last]).encode("utf-8", "surrogatepass")
            out.append((kind, shard, names, idf[first:last].tobytes(), count[first:last].astype(np.int32).tobytes(), doc[ends[first] : ends[last]].tobytes(), some.astype(np.min_scalar_type(some.max())).tobytes()))
            first = last
        names = ["kind", "shard", "terms", "idf", "n", "docs", "times"]
        return pa.table({c: pa.array([row[k] for row in out], pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(names)})

    return cut(messages.groupBy("kind", "shard").applyInArrow(of_shard, HELD))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Kind, rarity of terms, numbers of texts, firsts, texts and damped counts of each row of ``HELD``."""
    for batch in batches:
        for kind, idf, n, docs, times in zip(*(batch.column(c).to_pylist() for c in ("kind", "idf", "n", "docs", "times"))):
            idf, n, docs = np.frombuffer(idf), np.frombuffer(n, np.int32), np.frombuffer(docs, np.int32)
            times = np.frombuffer(times, np.dtype(f"u{len(times) // len(docs)}"))
            yield kind, idf, n, np.cumsum(n) - n, docs, 1 + np.log(times)


class Shards:
    """Features of ``n`` texts in shards by term: counts n as 1 + ln n times rarity, each kind of them at length 1."""

    def __init__(self, table: DataFrame, n: int) -> None:
        self.n, self.spark = n, table.sparkSession
        self.table = table.select("kind", "idf", "n", "docs", "times").coalesce(self.spark.sparkContext.defaultParallelism)
        squares = self._summed(lambda kind, idf, n, first, docs, x, out: out[kind].__iadd__(np.bincount(docs, (x * np.repeat(idf, n)) ** 2, len(out[kind]))), (2, self.n))
        self.scale = np.where(squares > 0, 1 / np.sqrt(np.where(squares > 0, squares, 1)), 0)  # kinds by texts

    def _summed(self, add, shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all shards of what ``add(*row, out)`` adds to an array; one of a task moves, by slices."""

        def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for row in _opened(batches):
                add(*row, out)
            flat = out.ravel()
            parts = [flat[i : i + SLICE].tobytes() for i in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["group", "slice", "data"])

        done = self.table.mapInArrow(of_partition, SUMS).repartition("slice").mapInArrow(_added, SUMS).toArrow().sort_by("slice")
        parts = [np.frombuffer(x) for x in done["data"].to_pylist()]
        return np.concatenate(parts).reshape(shape) if parts else np.zeros(shape)

    def products(self, a: np.ndarray) -> np.ndarray:
        """Each text's features times the sum of all texts' features, these times ``a`` (texts by columns)."""
        width = a.shape[1]
        shared = self.spark.sparkContext.broadcast(np.ascontiguousarray((self.scale[:, :, None] * a).transpose(0, 2, 1)))

        def add(kind: int, idf: np.ndarray, n: np.ndarray, first: np.ndarray, docs: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
            for k in range(width):
                weight = np.add.reduceat(x * shared.value[kind, k][docs], first) * idf**2
                out[kind, k] += np.bincount(docs, x * np.repeat(weight, n), out.shape[2])

        found = self._summed(add, (2, width, self.n))
        shared.unpersist()
        return np.einsum("kin,kn->ni", found, self.scale)

    def weights(self, table: DataFrame, a: np.ndarray) -> DataFrame:
        """``(kind, shard, terms, idf, weights)``: of each term its rarity and its weights, one array a column."""
        shared = self.spark.sparkContext.broadcast(np.ascontiguousarray((self.scale[:, :, None] * a).transpose(0, 2, 1)))

        def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [np.stack([np.add.reduceat(x * own[docs], first) * idf for own in shared.value[kind]] or [idf[:0]]).tobytes() for kind, idf, n, first, docs, x in _opened([batch])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "shard", "terms", "idf")), pa.array(made, pa.binary())], names=["kind", "shard", "terms", "idf", "weights"])

        return cut(table.mapInArrow(of_partition, "kind int, shard int, terms binary, idf binary, weights binary"))


def _chances(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of all labels, and the logarithm of what they are divided by, of margins of all labels but the last.

    Margins of a text add up to 0, as those of the fit with the least weights do."""
    whole = np.concatenate([margins, -margins.sum(axis=1, keepdims=True)], axis=1)
    top = whole.max(axis=1, keepdims=True)
    e = np.exp(whole - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, whole - top - np.log(total)


def _inner(u: np.ndarray, v: np.ndarray) -> float:
    """The product of two fits' weights of all labels, of one's shares and the other's products with the texts."""
    return float((u * v).sum() + (u.sum(axis=1) * v.sum(axis=1)).sum())


def fit(shards: Shards, y: np.ndarray, share: np.ndarray, labels: int, penalty: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Shares of the texts in the weights of each label but the last, what is added to its margins, and losses by step.

    The loss is the mean by ``share`` (its sum is 1) plus ``penalty`` / 2 times the squared weights. Steps are those of a
    quasi-Newton search over all weights. Each is a sum of texts' features, so shares and products stand for it: one pass over the shards
    gives both of a gradient, and looks along a step take none. The last row stands for what is added.
    """
    n, width = len(y), labels - 1
    a, ka = np.zeros((n + 1, width)), np.zeros((n + 1, width))
    if not width or not n:
        return a[:n], a[n], []
    truth = np.zeros((n, labels))
    truth[np.arange(n), y] = 1.0

    def loss(ka: np.ndarray, squared: float) -> tuple[float, np.ndarray]:
        p, log = _chances(ka[:n] + ka[n])
        return float(-(share * log[np.arange(n), y]).sum() + penalty / 2 * squared), (share[:, None] * (p - truth))[:, :width]

    def slope(first: np.ndarray, kd: np.ndarray) -> float:  # of the mean loss alone
        return _inner(first, kd[:n] + kd[n])

    value, first = loss(ka, 0.0)
    losses, past = [value], []
    gradient = lambda first, a: np.concatenate([first + penalty * a[:n], first.sum(axis=0, keepdims=True)])
    image = lambda first, g, ka: np.concatenate([shards.products(first) + penalty * ka[:n], g[n:]])
    g = gradient(first, a)
    kg = image(first, g, ka)
    for _ in range(STEPS):
        if _inner(g, kg) ** 0.5 <= max(TOLERANCE * abs(value), 1e-8):
            break
        d, kd, turns = -g, -kg, []
        for s, ks, t, kt in reversed(past):
            turn = _inner(s, kd) / _inner(s, kt)
            turns.append(turn)
            d, kd = d - turn * t, kd - turn * kt
        if past:
            s, ks, t, kt = past[-1]
            size = _inner(s, kt) / _inner(t, kt)
            d, kd = d * size, kd * size
        for (s, ks, t, kt), turn in zip(past, reversed(turns)):
            back = turn - _inner(t, kd) / _inner(s, kt)
            d, kd = d + back * s, kd + back * ks
        aa, ad, dd = _inner(a[:n], ka[:n]), _inner(a[:n], kd[:n]), _inner(d[:n], kd[:n])
        along = lambda x: slope(loss(ka + x * kd, 0.0)[1], kd) + penalty * (ad + x * dd)
        low, high = 0.0, 1.0
        while along(high) < 0 and high < 1e12:
            low, high = high, high * 4
        for _ in range(LOOKS):  # the loss is convex along a step
            if high - low <= 1e-3 * high:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if along(middle) < 0 else (low, middle)
        move = (low + high) / 2
        after, kafter = a + move * d, ka + move * kd
        value, first = loss(kafter, aa + 2 * move * ad + move * move * dd)
        new = gradient(first, after)
        knew = image(first, new, kafter)
        if _inner(move * d, knew - kg) > 0:
            past = [*past, (move * d, move * kd, new - g, knew - kg)][-MEMORY:]
        a, ka, g, kg = after, kafter, new, knew
        losses.append(value)
        if max(losses[-20:]) - value <= TOLERANCE * abs(losses[0]):
            break
    return a[:n], a[n], losses


class TermModel:
    """A fitted regression: its labels in order, what is added to their margins, and the table of weights by shard."""

    def __init__(self, labels: list[str], added: np.ndarray, weights: DataFrame, shards: int, text: str) -> None:
        self.labels, self.added, self.weights, self.shards, self.text = labels, added, weights, shards, text

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        facts = json.dumps({"labels": self.labels, "added": self.added.tolist(), "shards": self.shards, "text": self.text})
        self.weights.sparkSession.createDataFrame([(facts,)], "value string").write.mode("overwrite").text(f"{path}/terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TermModel:
        facts = json.loads(spark.read.text(f"{path}/terms").first()["value"])
        return cls(facts["labels"], np.array(facts["added"]), spark.read.parquet(f"{path}/weights"), facts["shards"], facts["text"])

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``y_pred`` and ``probabilities`` by label; of a text, what moves is a few numbers for each task."""
        width, columns = len(self.labels) - 1, rows.columns
        rows = cut(rows.withColumn("__doc", F.monotonically_increasing_id()))
        docs, _ = numbered(rows.select(F.col("__doc").alias("__row"), self.text))
        values = [f"m{k}" for k in range(width)]
        schema = ", ".join(["doc int", "kind int", "squares double", *(f"{v} double" for v in values)])

        def of_shard(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["doc", "kind", "squares", *values]
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * (1 + width)]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in kinds], names=names)
            terms = [t for own in right.column("terms").to_pylist() for t in own.decode("utf-8", "surrogatepass").split("\n")]
            idf = np.concatenate([np.frombuffer(x) for x in right.column("idf").to_pylist()])
            weights = np.concatenate([np.frombuffer(w).reshape(width, -1) for w in right.column("weights").to_pylist()], axis=1) if width else None
            _, term, doc, times = _met(left, {t: k for k, t in enumerate(terms)})
            some, at = np.unique(doc, return_inverse=True)
            x = (1 + np.log(times)) * idf[term]
            sums = [np.bincount(at, x**2, len(some)), *(np.bincount(at, x * weights[k][term], len(some)) for k in range(width))]
            return pa.table([pa.array(some, pa.int32()), pa.array(np.full(len(some), key[0].as_py()), pa.int32()), *(pa.array(s) for s in sums)], names=names)

        met = dealt(docs, self.text, self.shards).groupBy("kind", "shard").cogroup(self.weights.groupBy("kind", "shard")).applyInArrow(of_shard, schema)
        kinds = met.groupBy("doc", "kind").agg(*(F.sum(c).alias(c) for c in ("squares", *values)))
        unit = lambda v: F.sum(F.when(F.col("squares") > 0, F.col(v) / F.sqrt("squares")).otherwise(0.0)).alias(v)
        sums = kinds.groupBy("doc").agg(F.max("squares").alias("squares"), *map(unit, values))
        of_row = docs.select("__row", "__doc").join(sums, F.col("__doc") == F.col("doc"), "left").drop("__doc", "doc", "squares")
        margins = [F.coalesce(F.col(v), F.lit(0.0)) + F.lit(float(b)) for v, b in zip(values, self.added)]
        margins.append(-sum(margins, F.lit(0.0)))
        scored = cut(rows.join(of_row, F.col("__doc") == F.col("__row")).select(*columns, F.array(*margins).alias("__m")))
        e = F.transform("__m", lambda x: F.exp(x - F.array_max("__m")))
        total: Column = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        names = F.array(*map(F.lit, self.labels))
        best = F.element_at(names, F.array_position("__m", F.array_max("__m")).cast("int"))
        return scored.select(*columns, best.alias("y_pred"), F.map_from_arrays(names, F.transform(e, lambda x: x / total)).alias("probabilities"))


def fitted(train: DataFrame, label: str, text: str, c: float, least: tuple[float, float], at_once: int) -> TermModel | None:
    """The regression on all terms of ``train(label, text, class_weight)``; None where these are at most ``at_once``."""
    rows, n = numbered(train.select(F.col(label).cast("string").alias("__label"), F.col(text).alias(text), "class_weight"))
    chars = rows.agg(F.sum(F.length(text))).first()[0] or 0
    shards = int(max(1, -(-chars // SHARD)))
    table = held(dealt(rows, text, shards), n, least)
    if (table.agg(F.sum(F.length("idf"))).first()[0] or 0) // 8 <= at_once:
        return None
    labels = [r[0] for r in rows.select("__label").distinct().orderBy("__label").collect()]  # one row a class
    known = rows.select("__doc", (F.array_position(F.array(*map(F.lit, labels)), F.col("__label")) - 1).cast("int").alias("y"), "class_weight").toArrow().sort_by("__doc")
    y, weight = known["y"].to_numpy(), known["class_weight"].to_numpy()  # a label and a weight for each text
    features = Shards(table, n)
    a, added, _ = fit(features, y, weight / weight.sum(), len(labels), 1.0 / (c * weight.sum()))
    return TermModel(labels, added, features.weights(table, a), shards, text)

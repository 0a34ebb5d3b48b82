"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are of two blocks: hashed words and pairs of words, for what a text says, and trigrams of character
classes (letters, capitals and digits fall into one class each, marks keep their own) with how often words
repeat at short distance, for how it is written. Weighted term vectors of a bounded labelled sample are
reduced by a randomised singular value decomposition; the reduced sample, a matrix of fixed size, is
broadcast. Every document is projected, its cosines to all labelled vectors are computed in blocks, exactly, and
the labels of the nearest ones are weighed by similarity. A score hangs on its text alone: sums of a text
run in an order of their own, whatever other texts are scored with it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import fresh, table
from weftline.llm.labels import held_out, labelled_sample
from weftline.llm.shingles import mix, word_hashes

MODULUS, REST = 4, 2
THRESHOLD = 0.7
#: Bounds of the fitted sample, and so of what is broadcast: 2 * PER_CLASS vectors of RANK numbers.
PER_CLASS, LONGEST = 1000, 30_000
RANK, NEIGHBOURS = 48, 15
#: Buckets that words and pairs are hashed to. All terms that two texts of the sample have are used.
BUCKETS = 1 << 18
#: Axes beyond RANK, and passes, of the randomised decomposition.
SPARE, PASSES = 16, 3
#: Share of the squared length of a vector that its words make up.
WORD_SHARE = 0.25
#: Bytes of text, and rows of the product, that are worked on at a time; longer texts are read in blocks.
BYTES, ROWS = 1 << 19, 256
#: Cosines of the product this far below the last neighbour's are computed once more, each by itself.
NEAR = 1e-6

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS = np.zeros(256, dtype=np.int64)  # 0: other control characters
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x20] = 4
_CLASS[[0x0A, 0x0D]] = 5
_CLASS[0x09] = 6
_CLASS[_MARKS] = np.arange(7, 7 + len(_MARKS))
CLASSES = 7 + len(_MARKS)
#: Distances at which repeated words are terms, besides the class trigrams.
REPEATS = (1, 2, 3, 4)
#: Terms below this number say how a text is written, others what it says.
WRITTEN = CLASSES**3 + len(REPEATS)


def _raw_terms(texts: list[bytes], after: bytes = b"", goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all trigrams, repeats, words and pairs of the texts, and the text of each.

    ``after`` is what stands before a single text: it gives context, and no terms of its own. Where a text ``goes_on``
    behind its block, the block's end is no end of the text.
    """
    data = np.frombuffer(after + b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    sizes[0] += len(after)
    owner = np.repeat(np.arange(len(texts)), sizes)
    classes = _CLASS[data]
    trigrams = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:] if len(data) > 2 else np.zeros(0, np.int64)
    same = owner[:-2] == owner[2:] if len(data) > 2 else np.zeros(0, bool)
    same[: max(0, len(after) - 2)] = False
    if goes_on:
        same[-1:] = False
    terms, of = [trigrams[same]], [owner[:-2][same] if len(data) > 2 else np.zeros(0, np.int64)]
    words, starts = word_hashes(data)
    by, old = owner[starts], int(np.searchsorted(starts, len(after)))
    for k, distance in enumerate(REPEATS):
        again = np.flatnonzero((words[distance:] == words[:-distance]) & (by[distance:] == by[:-distance])) if len(words) > distance else np.zeros(0, np.int64)
        again = again[again + distance >= old]
        terms.append(np.full(len(again), CLASSES**3 + k))
        of.append(by[again])
    follows = by[1:] == by[:-1]
    follows[: max(0, old - 1)] = False
    for hashes, owners in ((words[old:], by[old:]), (mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[follows], by[:-1][follows])):
        terms.append(WRITTEN + (hashes % np.uint64(BUCKETS)).astype(np.int64))
        of.append(owners)
    return np.concatenate(terms), np.concatenate(of)


def _counted(terms: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) in order, and how often each occurs."""
    keys = np.sort(of * (WRITTEN + BUCKETS) + terms)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first] // (WRITTEN + BUCKETS), keys[first] % (WRITTEN + BUCKETS), np.diff(first, append=len(keys))


def _blocks(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(what stands before, block) for blocks of a long text, cut behind white space between two words.

    What stands before has the last words that terms of the block look back to, and its last two bytes.
    """
    at, before = 0, b""
    while at < len(text):
        end = min(len(text), at + BYTES)
        while at < end < len(text) and not _BLANK[text[end - 1]]:
            end -= 1
        if end == at:  # a word over the whole block, which is its first block's
            end = at + BYTES
        yield before, text[at:end]
        start = end
        for _ in range(max(REPEATS)):
            while max(0, end - BYTES) < start and _BLANK[text[start - 1]]:
                start -= 1
            while max(0, end - BYTES) < start and not _BLANK[text[start - 1]]:
                start -= 1
        before, at = text[max(0, min(start, end - 2)) : end], end


def _sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) of some texts with counts; a long text alone, in blocks."""
    if len(texts) > 1 or len(texts[0]) <= 2 * BYTES:
        return _counted(*_raw_terms(texts))
    total = np.zeros(WRITTEN + BUCKETS, dtype=np.int64)
    left = len(texts[0])
    for before, block in _blocks(texts[0]):
        left -= len(block)
        total += np.bincount(_raw_terms([block], before, left > 0)[0], minlength=len(total))
    terms = np.flatnonzero(total)
    return np.zeros(len(terms), np.int64), terms, total[terms]


@dataclasses.dataclass
class Model:
    columns: np.ndarray  # term number -> column, -1 for terms that are not used
    weights: np.ndarray  # inverse document frequencies by column
    axes: np.ndarray  # columns by RANK
    vectors: np.ndarray  # labelled vectors, each of length 1
    labels: np.ndarray
    written: int  # columns before this one are of the first block

    def weighted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, column, value) of term vectors of length 1; texts without known terms have none."""
        of, terms, counts = _sparse(texts)
        column = self.columns[terms]
        known = column >= 0
        of, column, counts = of[known], column[known], counts[known].astype(np.float64)
        # shares, not counts: a text's length is no term of it
        words = (column >= self.written).astype(np.int64)
        block = 2 * of + words
        sums = lambda x, by, n: np.bincount(by, weights=x, minlength=n)[by]  # noqa: E731  one after the other, in the order of terms
        value = np.sqrt(counts / sums(counts, block, 2 * len(texts))) * self.weights[column]
        value *= np.sqrt(np.where(words, WORD_SHARE, 1 - WORD_SHARE)) / np.maximum(np.sqrt(sums(value**2, block, 2 * len(texts))), 1e-12)
        return of, column, value / np.maximum(np.sqrt(sums(value**2, of, len(texts))), 1e-12)

    def projected(self, texts: list[bytes]) -> np.ndarray:
        """Vectors of texts along the axes, of length 1 (or 0 where no term is known)."""
        out = np.zeros((len(texts), self.axes.shape[1]))
        of, column, value = self.weighted(texts)
        if len(of):
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(begins[1:], len(of))
            for a, b in zip(begins, ends):
                out[of[a]] = (value[a:b, None] * self.axes[column[a:b]]).sum(axis=0)
        length = np.sqrt((out**2).sum(axis=1))
        return np.where(length[:, None] > 1e-9, out / np.maximum(length, 1e-12)[:, None], 0.0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Shares of label 1 among the nearest labelled vectors, by similarity; 0 for texts without known terms.

        Cosines that agree to nine digits are ties: all that tie with the last of the nearest vote as well. The product
        of a block finds which vectors can be neighbours; their cosines are then summed one by one.
        """
        out, k = np.zeros(len(texts)), min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), ROWS):
            projected = self.projected(texts[at : at + ROWS])
            about = projected @ self.vectors.T
            rows, which = np.nonzero(about >= -np.partition(-about, k - 1, axis=1)[:, k - 1 : k] - NEAR)
            cosine = np.full(about.shape, -np.inf)
            exact = (projected[rows] * self.vectors[which]).sum(axis=1)
            cosine[rows, which] = np.round(exact, 9)
            last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
            votes = cosine[rows, which] >= last[rows]
            rows, which = rows[votes], which[votes]
            weight = np.maximum(exact[votes], 0) ** 8 + 1e-9
            total, ones = (np.bincount(rows, weights=x, minlength=len(projected)) for x in (weight, weight * self.labels[which]))
            out[at : at + ROWS] = np.where((projected != 0).any(axis=1), ones / total, 0.0)
        return np.round(np.clip(out, 0, 1), 12)


def fit(texts: list[str], labels: list[int]) -> Model | float:
    """A model of labelled texts, or the share of label 1 (0.5 of none) where only one label occurs."""
    y = np.array(labels, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    raw = [t.encode("utf-8", "replace") for t in texts]
    spread = np.zeros(WRITTEN + BUCKETS, dtype=np.int64)
    for at in range(0, len(raw), 64):
        spread += np.bincount(_counted(*_raw_terms(raw[at : at + 64]))[1], minlength=len(spread))
    used = np.flatnonzero(spread > 1)
    used = used if len(used) else np.array([int(spread.argmax())])
    columns = np.full(len(spread), -1)
    columns[used] = np.arange(len(used))
    model = Model(columns, np.log((1 + len(raw)) / (1 + spread[used])) + 0.3, np.zeros((len(used), 0)), np.zeros((0, 0)), y, int((used < WRITTEN).sum()))
    parts = [model.weighted(raw[at : at + 64]) for at in range(0, len(raw), 64)]
    of = np.concatenate([64 * k + part[0] for k, part in enumerate(parts)])
    column, value = (np.concatenate([part[i] for part in parts]) for i in (1, 2))
    model.axes = _axes(of, column, value, len(raw), len(used), min(RANK, len(used), len(raw)))
    model.vectors = np.concatenate([model.projected(raw[at : at + ROWS]) for at in range(0, len(raw), ROWS)])
    return model


def _axes(of: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, width: int, rank: int) -> np.ndarray:
    """The first right singular vectors of a sparse matrix (entries in order of rows), by a randomised range finder."""
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    rows = list(zip(of[begins], begins, np.append(begins[1:], len(of))))

    def times(m: np.ndarray) -> np.ndarray:
        out = np.zeros((n, m.shape[1]))
        for row, a, b in rows:
            out[row] = value[a:b] @ m[column[a:b]]
        return out

    def turned(m: np.ndarray) -> np.ndarray:
        out = np.zeros((width, m.shape[1]))
        for row, a, b in rows:  # a column stands once in a row
            out[column[a:b]] += value[a:b, None] * m[row]
        return out

    left = times(np.random.default_rng(11).standard_normal((width, min(rank + SPARE, width, n))))
    for _ in range(PASSES):
        left = times(turned(np.linalg.qr(left)[0]))
    right = turned(np.linalg.qr(left)[0])
    values, turn = np.linalg.eigh(right.T @ right)
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-9]
    return right @ (turn[:, best] / np.sqrt(values[best]))


def score_quality(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """Rows of ``docs`` with score and predicted: the id and these, or with ``keep_columns`` all columns of ``docs``
    and, last, the two under names that are free there.

    Whole texts are scored; null texts count as empty. Texts without a known term (empty ones above all)
    score 0. Rows are independent, and equal texts score alike: ids may be null or repeat, and an empty table gives
    an empty table. A text of more than 2 * BYTES is read in blocks, so it costs little more memory than its
    own bytes. The model is broadcast and bounded by its parameters; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    text = F.col(text_col).cast("string").alias(fresh("text", docs))
    rows = docs.select("*", text) if keep_columns else docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    added = (fresh("score", docs), fresh("predicted", docs)) if keep_columns else ("score", "predicted")
    names = [*rows.columns[:-1], *added]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and len(some) < ROWS and (not some or size + len(texts[at + len(some)] or b"") <= BYTES):
                    some.append(texts[at + len(some)] or b"")
                    size += len(some[-1])
                scores = fitted.scores(some) if isinstance(fitted, Model) else np.full(len(some), fitted)
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=names)
                at += len(some)

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(of_partition, f"{before}, `{added[0]}` double, `{added[1]}` int")


def fit_on(docs: DataFrame, labels: DataFrame) -> Model | float:
    return fit(*labelled_sample(docs, labels, "quality", MODULUS, REST, PER_CLASS, LONGEST))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", "predicted")

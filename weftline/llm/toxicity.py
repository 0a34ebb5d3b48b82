"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (words of the sample; one more for all others) and the mean of vectors of
its character n-grams. Overlapping windows of words run through both directions; attention weighs the
states, and a text scores as its highest window. Fitting picks, again and again, the window of each text
that decides its score, so that only texts need labels.

A score hangs on its text alone: sums of products run feature by feature, over windows in blocks of one shape that
are filled up with blanks, so no other text changes their order.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import fresh, table
from weftline.llm.labels import held_out, labelled_sample
from weftline.llm.shingles import _powers, mix

MODULUS, REST = 5, 0
#: Bounds of the fitted sample.
PER_CLASS, LONGEST = 1200, 30_000
WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 16, 8, 8
GRAM_BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
#: Steps of a round at least; a small sample is passed over again until there are so many.
UPDATES = 24
#: Distinct words whose n-grams are laid out at a time, windows that are scored at a time, bytes of text.
WORDS_AT_ONCE, WINDOWS, BYTES = 20_000, 256, 1 << 19
#: Bytes of a run that is one word; a longer run is several, one behind the other.
LONGEST_WORD = 4096

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUES = np.random.default_rng(5).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclasses.dataclass
class Words:
    """Distinct words of some texts, and the texts as positions among them."""

    hashes: np.ndarray  # of the distinct words
    data: np.ndarray  # bytes of the distinct words, each between two 0 bytes
    bounds: np.ndarray  # where each begins (its first 0) in data; one more at the end
    positions: np.ndarray  # of all words of all texts
    texts: np.ndarray  # where each text begins in positions; one more at the end

    def some(self, which: np.ndarray) -> Words:
        """Chosen distinct words, apart from any text."""
        lengths = (self.bounds[1:] - self.bounds[:-1])[which]
        ends = np.cumsum(lengths)
        data = self.data[np.repeat(self.bounds[:-1][which] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        return Words(self.hashes[which], data, np.concatenate(([0], ends)), np.zeros(0, np.int64), np.zeros(1, np.int64))


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin and end."""
    edge = np.diff(_WORD_BYTE[data].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if (parts := -(-(ends - starts) // LONGEST_WORD)).max(initial=1) > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * LONGEST_WORD
        ends = np.minimum(np.repeat(ends, parts), starts + LONGEST_WORD)
    return starts, ends


def read_words(texts: list[bytes]) -> Words:
    """Runs of letters, digits and bytes above 127, with A-Z lower-cased."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    starts, ends = _bounds(data)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    distinct, first, positions = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends[first] - starts[first] + 2
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)  # place in the word, 0 and last for the zeros
    source = np.repeat(starts[first], lengths) + at - 1
    out = np.where((at == 0) | (at == np.repeat(lengths, lengths) - 1), 0, data[np.clip(source, 0, len(data) - 1)]).astype(np.uint8) if len(distinct) else np.zeros(0, np.uint8)
    begins = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return Words(distinct, out, bounds, positions.astype(np.int64), begins)


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the distinct words, and the word each belongs to (in order of words)."""
    n_words = len(words.hashes)
    owner = np.repeat(np.arange(n_words), np.diff(words.bounds))
    buckets, owners = [], []
    for n in GRAMS:
        if len(words.data) < n:
            continue
        code = np.full(len(words.data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + words.data[k : len(words.data) - n + 1 + k]
        same = owner[: len(code)] == owner[n - 1 :]
        buckets.append((mix(code[same]) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
        owners.append(owner[: len(code)][same])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return bucket[order], own[order]


def stretches(text: bytes) -> Iterator[bytes]:
    """A long text in parts that together have its windows, each but the last whole windows and no more."""
    if len(text) <= 2 * BYTES:
        yield text
        return
    carry = b""
    for at in range(0, len(text), BYTES):
        part = carry + text[at : at + BYTES]
        if at + BYTES >= len(text):
            yield part
            return
        starts, ends = _bounds(np.frombuffer(part, dtype=np.uint8))
        words = [part[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        goes_on = len(words) > 0 and ends[-1] == len(part)
        # so many windows that the text reaches over the last of them
        n = max(0, (len(words) - goes_on - (WINDOW - STRIDE) - 1) // STRIDE)
        if n:
            yield b" ".join(words[: (n - 1) * STRIDE + WINDOW])
        carry = b" ".join(words[n * STRIDE :]) + (b"" if goes_on else b" ")


def windows(words: Words, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all overlapping windows (WINDOW by windows), padded with ``blank``, and the text of each.

    A text of n words has windows at 0, STRIDE, ... until one reaches its end; a text without words has one
    window of blanks.
    """
    sizes = np.diff(words.texts)
    per_text = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(sizes)), per_text)
    nth = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = (words.texts[:-1][text] + nth * STRIDE)[None, :] + np.arange(WINDOW)[:, None]
    inside = at < words.texts[1:][text][None, :]
    padded = np.append(words.positions, blank)
    return np.where(inside, padded[np.minimum(at, len(words.positions))], blank), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``w.T @ x`` for columns ``x`` of their own, added in the order of rows (matrix products add as it suits their tiles)."""
    out = w[0][:, None] * x[0]
    part = np.empty_like(out)
    for k in range(1, len(x)):
        np.multiply(w[k][:, None], x[k], out=part)
        out += part
    return out


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, vocabulary: np.ndarray, seed: int) -> None:
        """``vocabulary``: sorted hashes of the words that have vectors of their own."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        dim, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        self.p = {
            "words": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "grams": draw(GRAM_BUCKETS, CHAR_DIM, scale=0.3),
            "w": draw(dim, 6 * h, scale=dim**-0.5), "b": np.zeros(6 * h, np.float32), "u": draw(2, h, 3 * h, scale=h**-0.5), "c": np.zeros((2, h), np.float32),
            "att": draw(2 * h, ATTENTION, scale=0.25), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION, scale=0.35),
            "out": draw(2 * h, scale=0.25), "out_b": np.zeros(1, np.float32),
        }

    def inputs(self, words: Words, drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Vectors of the distinct words (a last one, of zeros, for blanks), their rows, and the n-grams of the last words."""
        at = np.searchsorted(self.vocabulary, words.hashes)
        known = (at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words.hashes) if len(self.vocabulary) else np.zeros(len(words.hashes), bool)
        if drop is not None:
            known &= ~drop
        rows = np.where(known, at + 1, 0)
        x = np.zeros((len(words.hashes) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:-1, :WORD_DIM] = self.p["words"][rows]
        found = None
        for at in range(0, len(words.hashes), WORDS_AT_ONCE):
            some = words.some(np.arange(at, min(len(words.hashes), at + WORDS_AT_ONCE))) if len(words.hashes) > WORDS_AT_ONCE else words
            bucket, own = grams(some)
            counts = np.bincount(own, minlength=len(some.hashes))
            if len(bucket):
                full = np.flatnonzero(counts)
                begins = np.cumsum(counts[full]) - counts[full]
                x[at + full, WORD_DIM:] = np.add.reduceat(self.p["grams"][bucket], begins, axis=0) / counts[full][:, None]
            found = (bucket, own, counts)
        return x, rows, found

    def forward(self, projected: np.ndarray, at: np.ndarray, blank: int, keep: bool = False):
        """Logits of windows ``at`` (WINDOW by windows) over ``projected`` inputs of distinct words."""
        h, (steps, n) = HIDDEN, at.shape
        states = np.empty((steps, n, 2 * h), np.float32)
        kept = {}
        for way in (0, 1):
            u, c = self.p["u"][way], self.p["c"][way]
            own = np.ascontiguousarray(projected[:, way * 3 * h : (way + 1) * 3 * h])
            state = np.zeros((n, h), np.float32)
            memory = [None] * steps
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x = own[at[t]]
                pre = state @ u
                gates = _sigmoid(x[:, : 2 * h] + pre[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                inner = pre[:, 2 * h :] + c
                new = np.tanh(x[:, 2 * h :] + r * inner)
                before, state = state, new + z * (state - new)
                states[t, :, way * h : (way + 1) * h] = state
                if keep:
                    memory[t] = (before, z, r, inner, new)
            kept[way] = memory
        hidden = np.tanh(states.reshape(-1, 2 * h) @ self.p["att"] + self.p["att_b"])
        weight = (hidden @ self.p["att_v"]).reshape(steps, n)
        real = at != blank
        real[0] |= ~real.any(axis=0)
        weight = np.exp(np.where(real, weight - weight.max(axis=0), -np.inf))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        logits = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logits, (states, kept, hidden, weight, pooled)) if keep else logits

    def gradients(self, x: np.ndarray, at: np.ndarray, blank: int, targets: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted log loss; those of the inputs of distinct words come apart."""
        p, h, (steps, n) = self.p, HIDDEN, at.shape
        projected = x @ p["w"] + p["b"]
        logits, (states, kept, hidden, weight, pooled) = self.forward(projected, at, blank, keep=True)
        d_logit = ((_sigmoid(logits) - targets) * weights / weights.sum()).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled[None]
        d_weight = np.einsum("nd,tnd->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        flat = d_score.reshape(-1)
        g["att_v"] = hidden.T @ flat
        d_hidden = flat[:, None] * p["att_v"] * (1 - hidden**2)
        g["att"], g["att_b"] = states.reshape(-1, 2 * h).T @ d_hidden, d_hidden.sum(axis=0)
        d_states += (d_hidden @ p["att"].T).reshape(states.shape)
        g["u"], g["c"] = np.zeros_like(p["u"]), np.zeros_like(p["c"])
        d_x = np.zeros((steps, n, 6 * h), np.float32)
        for way in (0, 1):
            u, carry = p["u"][way], np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                before, z, r, inner, new = kept[way][t]
                d = d_states[t, :, way * h : (way + 1) * h] + carry
                d_new = d * (1 - z) * (1 - new**2)
                d_pre = np.concatenate((d * (before - new) * z * (1 - z), d_new * inner * r * (1 - r), d_new * r), axis=1)
                carry = d * z + d_pre @ u.T
                g["u"][way] += before.T @ d_pre
                g["c"][way] += d_pre[:, 2 * h :].sum(axis=0)
                d_x[t, :, way * 3 * h : way * 3 * h + 2 * h] = d_pre[:, : 2 * h]
                d_x[t, :, way * 3 * h + 2 * h : (way + 1) * 3 * h] = d_new
        d_projected = np.zeros_like(projected)
        np.add.at(d_projected, at.reshape(-1), d_x.reshape(-1, 6 * h))
        g["w"], g["b"] = x.T @ d_projected, d_projected.sum(axis=0)
        return g, d_projected @ p["w"].T

    def projected(self, words: Words) -> np.ndarray:
        """What the distinct words (and a last one, a blank) put into both directions, features by words."""
        return _product(np.ascontiguousarray(self.inputs(words)[0].T), self.p["w"]) + self.p["b"][:, None]

    def logits(self, projected: np.ndarray, at: np.ndarray, blank: int) -> np.ndarray:
        """Logits of windows as of ``forward``, each by sums of its own."""
        n = at.shape[1]
        padded = np.full((len(at), -(-n // WINDOWS) * WINDOWS), blank)
        padded[:, :n] = at
        return np.concatenate([self._block(projected, np.ascontiguousarray(padded[:, k : k + WINDOWS]), blank) for k in range(0, padded.shape[1], WINDOWS)])[:n]

    def _block(self, projected: np.ndarray, at: np.ndarray, blank: int) -> np.ndarray:
        p, h, (steps, n) = self.p, HIDDEN, at.shape
        states = np.empty((steps, 2 * h, n), np.float32)
        for way in (0, 1):
            own, u, c = projected[way * 3 * h : (way + 1) * 3 * h], p["u"][way], p["c"][way][:, None]
            state = np.zeros((h, n), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x, pre = np.take(own, at[t], axis=1), _product(state, u)
                gates = _sigmoid(x[: 2 * h] + pre[: 2 * h])
                new = np.tanh(x[2 * h :] + gates[h:] * (pre[2 * h :] + c))
                state = new + gates[:h] * (state - new)
                states[t, way * h : (way + 1) * h] = state
        flat = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(2 * h, -1)
        hidden = np.tanh(_product(flat, p["att"]) + p["att_b"][:, None])
        weight = _product(hidden, p["att_v"][:, None]).reshape(steps, n)
        real = at != blank
        real[0] |= ~real.any(axis=0)
        weight = np.exp(np.where(real, weight - weight.max(axis=0), -np.inf))
        weight /= weight.sum(axis=0)
        return _product((states * weight[:, None]).sum(axis=0), p["out"][:, None])[0] + p["out_b"][0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Per text the probability of its highest window, to six digits."""
        best = np.full(len(texts), -np.inf)

        def score(some: list[tuple[int, bytes]]) -> None:
            words = read_words([part for _, part in some])
            at, part = windows(words, blank := len(words.hashes))
            np.maximum.at(best, np.array([k for k, _ in some])[part], self.logits(self.projected(words), at, blank))

        some, size = [], 0
        for k, text in enumerate(texts):
            for part in stretches(text):
                if some and size + len(part) > BYTES:
                    score(some)
                    some, size = [], 0
                some.append((k, part))
                size += len(part)
        if some:
            score(some)
        return np.round(1 / (1 + np.exp(-best.astype(np.float64))), 6)


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def update(self, params: dict, gradients: dict) -> None:
        self.step += 1
        for name, g in gradients.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * g**2
            params[name] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def fit(texts: list[str], labels: list[int], rounds: int = 7, batch: int = 128, seed: int = 17) -> Network | float:
    """A network fitted to labelled texts, or the share of label 1 (0.5 of none) where only one label occurs."""
    y = np.array(labels, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    raw = [t.encode("utf-8", "replace") for t in texts]
    words = read_words(raw)
    owner = np.repeat(np.arange(len(raw)), np.diff(words.texts))
    spread = np.bincount(np.unique(owner * len(words.hashes) + words.positions) % max(1, len(words.hashes)), minlength=len(words.hashes))
    net = Network(words.hashes[spread >= 4], seed)  # sorted, as np.unique leaves them
    at, text = windows(words, blank := len(words.hashes))
    adam, squares = _Adam(0.01), {"words": np.full(len(net.p["words"]), 1e-8, np.float32), "grams": np.full(GRAM_BUCKETS, 1e-8, np.float32)}
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    for turn in range(rounds):
        if turn < 2:  # no window is known to decide yet: two of each text by chance
            key = rng.random(len(text))
        else:
            key = net.logits(net.projected(words), at, blank)
        order = np.lexsort((-key, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = order[rank < (2 if turn < 2 else 1)] if turn < 2 else order[(rank == 0) | ((rank < 3) & (y[text[order]] == 0))]
        parts = max(1, len(chosen) // batch)
        for part in itertools.chain.from_iterable(np.array_split(rng.permutation(chosen), parts) for _ in range(-(-UPDATES // parts))):
            used, where = np.unique(at[:, part], return_inverse=True)
            real = used[used != blank]
            x, rows, (b, o, counts) = net.inputs(words.some(real), drop=rng.random(len(real)) < 0.3)
            g, d_x = net.gradients(x, where.reshape(at[:, part].shape), len(real), y[text[part]], balance[text[part]])
            adam.rate = 0.01 * (1 - turn / rounds) + 0.001
            adam.update(net.p, g)
            _sparse(net.p["words"], squares["words"], rows, d_x[:-1, :WORD_DIM])
            _sparse(net.p["grams"], squares["grams"], b, (d_x[:-1, WORD_DIM:] / np.maximum(counts, 1)[:, None])[o])
    return net


def _sparse(values: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float = 0.05) -> None:
    """Adagrad on the rows that a batch touched."""
    if not len(rows):
        return
    order = np.argsort(rows, kind="stable")
    distinct, begins = np.unique(rows[order], return_index=True)
    total = np.add.reduceat(gradient[order], begins, axis=0)
    squares[distinct] += (total**2).mean(axis=1)
    values[distinct] -= rate * total / np.sqrt(squares[distinct])[:, None]


def score_toxicity(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """Rows of ``docs`` with score and predicted: the id and these, or with ``keep_columns`` all columns of ``docs``
    and, last, the two under names that are free there.

    Whole texts are scored, in overlapping windows; null texts count as empty, and texts without words score
    as one blank window does. Rows are independent, and equal texts score alike: ids may be null or repeat, and an
    empty table gives an empty table. A text of more than 2 * BYTES is read in stretches, so it costs little more
    memory than its own bytes. The model (some MB) is broadcast; nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    text = F.col(text_col).cast("string").alias(fresh("text", docs))
    rows = docs.select("*", text) if keep_columns else docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    added = (fresh("score", docs), fresh("predicted", docs)) if keep_columns else ("score", "predicted")
    names = [*rows.columns[:-1], *added]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and (not some or size < 4 * BYTES):
                    some.append(texts[at + len(some)] or b"")
                    size += len(some[-1])
                scores = net.scores(some) if isinstance(net, Network) else np.full(len(some), net)
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=names)
                at += len(some)

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(of_partition, f"{before}, `{added[0]}` double, `{added[1]}` int")


def fit_on(docs: DataFrame, labels: DataFrame) -> Network | float:
    return fit(*labelled_sample(docs, labels, "toxic", MODULUS, REST, PER_CLASS, LONGEST))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", "predicted")

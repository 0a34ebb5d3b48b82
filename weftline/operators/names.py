"""Names by a linear-chain conditional random field, labelled by a cast's phrases alone.

A cast tells for some words that they are names. Small words and words that a corpus writes small are none; of
other capitalised words nothing is known, and the field sums over their labels when it is fitted. What it learns from
shapes, endings and neighbours carries over to names that no cast lists.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import fixed
from weftline.operators.mentions import phrase_pattern, zipfs
from weftline.session import cut

OUTSIDE, BEGIN, INSIDE = range(3)
LABELS = 3
#: Buckets that features are hashed to, and features of a word by itself and as a neighbour.
BUCKETS, OWN, NEAR = 1 << 16, 6, 3
#: What makes other numbers of a word's features where it stands before or after another.
BEFORE, AFTER = (40_503, 11), (48_271, 23)
#: Lines to fit on at most, half of them with a phrase of the cast, and words of a line that are used for that.
LINES, LONGEST = 4000, 60
#: Words that are labelled at a time, padded; a longer line goes alone.
WORDS = 1 << 17
#: Characters of lines that are split into words at a time; a longer line goes alone.
CHARACTERS = 1 << 22
#: From this many occurrences a billion words (as a power of ten) a word written small is common.
COMMON = 2.0

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]")
_NONE = -1e30


class _Kinds(dict):
    """Of each code point X or x for letters with a case, d for digits, itself for others; as ``str.translate`` asks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        return self.setdefault(code, "X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c)


_KINDS = _Kinds()
#: Checksums of what features begin with, which those of features go on from.
_W, _A, _Z, _N, _ONE = (zlib.crc32(b) for b in (b"w=", b"a=", b"z=", b"n=", b"1"))
_shape = functools.lru_cache(1 << 14)(lambda kinds: zlib.crc32(("s=" + re.sub(r"(.)\1+", r"\1", kinds)).encode()))


class Features:
    """Numbers of the features of words, kept for words that come again."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        low, kinds, crc = word.lower(), word[:12].translate(_KINDS), zlib.crc32
        return crc(low.encode(), _W), _shape(kinds), crc(low[:3].encode(), _A), crc(low[-3:].encode(), _Z), crc(f"{min(len(word), 9)}{kinds[:1]}".encode(), _N), _ONE

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        return np.array([known.get(w) or known.setdefault(w, self._of(w)) for w in words], dtype=np.int64).reshape(-1, OWN)

    def lines(self, lines: list[list[str]]) -> np.ndarray:
        """(words, OWN + 2 * NEAR) bucket numbers of the words of all lines, one line after the other."""
        own = self.words([w for line in lines for w in line])
        n, at = len(own), np.arange(len(own))
        first = np.repeat(np.cumsum([0, *map(len, lines[:-1])]), list(map(len, lines))) if lines else at
        last = np.repeat(np.cumsum(list(map(len, lines))) - 1, list(map(len, lines))) if lines else at
        edge = np.full(NEAR, 7, dtype=np.int64)
        before = np.where((at > first)[:, None], own[np.maximum(at - 1, 0), :NEAR], edge) * BEFORE[0] + BEFORE[1]
        after = np.where((at < last)[:, None], own[np.minimum(at + 1, max(n - 1, 0)), :NEAR], edge) * AFTER[0] + AFTER[1]
        return np.concatenate([own, before, after], axis=1) % BUCKETS


@dataclasses.dataclass
class Field:
    """Weights of features by label, of labels that follow each other, and of the first label."""

    node: np.ndarray
    step: np.ndarray
    start: np.ndarray


@functools.cache
def _classes() -> np.ndarray:
    """Of each code point what ``_WORD`` sees in it: 1 of a word, 2 joins words, 3 stands alone, 0 none of these."""
    every = map(chr, range(sys.maxunicode + 1))
    return np.array([1 if c.isalnum() else 2 if c in "'’-" else 0 if c.isspace() or c == "_" else 3 for c in every], dtype=np.uint8)


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts, the number among them of every word in the order of the texts, and words of each text.

    The same words as ``_WORD`` finds, by passes over the characters of all texts.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(list(map(len, texts)))
    if not len(codes):
        return [], np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    kind = _classes()[codes]
    first = np.zeros(len(codes) + 1, dtype=bool)  # of a text
    first[0] = first[ends] = True
    inside = kind == 1
    joins = np.flatnonzero(kind[1:-1] == 2) + 1
    joins = joins[inside[joins - 1] & inside[joins + 1] & ~first[joins] & ~first[joins + 1]]
    inside[joins] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    begins |= (kind >= 2) & ~inside
    kept = codes[inside | begins]
    starts = np.flatnonzero(begins[inside | begins])
    n_bytes = np.concatenate(([0], np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000), dtype=np.int64)))
    offsets = np.append(n_bytes[starts], n_bytes[-1])
    data = kept.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    before = np.concatenate(([0], np.cumsum(begins)))[np.concatenate(([0], ends))]
    return [w.decode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()], words.indices.to_numpy(), np.diff(before)


class Scores:
    """Scores of labels by the words of lines: what a word, the one before it and the one after it add is kept for each word."""

    def __init__(self, field: Field, most: int = 200_000) -> None:
        self.node, self.most, self.features = field.node, most, Features(0)
        self.edge = self._around(np.full((1, NEAR), 7, dtype=np.int64))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tables = np.empty((1 + 2 * NEAR, 1 << 14, LABELS))  # by own features together, each of the word before, each of the word after

    def _around(self, own: np.ndarray) -> list[np.ndarray]:
        """What each feature of the word before, and of the word after, adds."""
        return [self.node[(own.T[:NEAR] * by + more) % BUCKETS] for by, more in (BEFORE, AFTER)]

    def lines(self, distinct: list[str], numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(words, labels) of what ``split_words`` gives, added up in the order of features."""
        if len(self.known) > self.most:
            self._forget()
        known = self.known
        if new := [w for w in distinct if w not in known]:
            held, own = len(known), self.features.words(new)
            known.update(zip(new, range(held, held + len(new))))
            if len(known) > self.tables.shape[1]:
                self.tables, former = np.empty((1 + 2 * NEAR, 2 * len(known), LABELS)), self.tables
                self.tables[:, :held] = former[:, :held]
            self.tables[:, held : len(known)] = np.concatenate([self.node[own % BUCKETS].sum(axis=1)[None], *self._around(own)])
        at = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[numbers]
        some = sizes[sizes > 0]
        last = np.cumsum(some) - 1
        out = self.tables[0].take(at, axis=0)
        # at a line's end the edge stands where the next or the former line would
        for features, other, edges, edge in zip((self.tables[1 : 1 + NEAR], self.tables[1 + NEAR :]), (np.roll(at, 1), np.roll(at, -1)), (last - some + 1, last), self.edge):
            for table, none in zip(features, edge):
                add = table.take(other, axis=0)
                add[edges] = none
                out += add
        return out


def padded(lines: list[int], values: np.ndarray, fill: float) -> np.ndarray:
    """(longest, lines, ...) of the values of lines that stand one after the other."""
    out = np.full((max(lines, default=0), len(lines), *values.shape[1:]), fill)
    of = np.repeat(np.arange(len(lines)), lines)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lines) - lines, lines)
    out[at, of] = values
    return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(field: Field, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums of lines, marginals of words (longest, lines, labels), and expected numbers of steps by pair of labels,
    by forward and backward passes over ``scores`` of the same shape."""
    steps, n, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    for t in range(steps):
        forward[t] = scores[t] + (field.start if t == 0 else _sum(forward[t - 1][:, :, None] + field.step, 1))
    last = np.arange(n)
    total = _sum(forward[sizes - 1, last], 1)
    pairs = np.zeros((LABELS, LABELS))
    for t in range(steps - 2, -1, -1):
        onward = field.step + (scores[t + 1] + backward[t + 1])[:, None, :]
        inside = t + 1 < sizes
        backward[t] = np.where(inside[:, None], _sum(onward, 2), 0)
        pairs += np.exp(forward[t][:, :, None] + onward - total[:, None, None])[inside].sum(axis=0)
    inside = np.arange(steps)[:, None] < sizes
    return total, np.where(inside[:, :, None], np.exp(forward + backward - total[None, :, None]), 0), pairs


def viterbi(field: Field, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The likeliest labels of lines (longest, lines); of equally likely ones the smaller numbers from the end."""
    steps, n, _ = scores.shape
    by_label = np.ascontiguousarray(scores.transpose(0, 2, 1))  # lines are many and labels few
    back, ends = np.zeros((steps, LABELS, n), dtype=np.int8), np.zeros((LABELS, n))
    shortest = sizes.min(initial=steps)
    for t in range(steps):
        if t == 0:
            best = by_label[0] + field.start[:, None]
        else:
            outside, begin, inside = best[:, None, :] + field.step[:, :, None]
            either = np.maximum(outside, begin)
            back[t] = np.where(inside > either, INSIDE, begin > outside)
            best = by_label[t] + np.maximum(either, inside)
        if t + 1 >= shortest:
            over = sizes == t + 1
            ends[:, over] = best[:, over]
    out, rows = np.zeros((steps, n), dtype=np.int8), np.arange(n)
    now = ends.argmax(axis=0)
    for t in range(steps - 1, -1, -1):
        inside = t < sizes
        out[t, inside] = now[inside]
        now = np.where(inside & (t > 0), back[t, now, rows], now)
    return out


def fit(lines: list[list[str]], allowed: list[np.ndarray], rounds: int = 8, batch: int = 64, rate: float = 0.4, decay: float = 1e-3, seed: int = 3) -> Field:
    """A field of lines of words and the labels that each word may have (words by labels, boolean).

    The likelihood of all labellings that are allowed, against all there are; Adagrad over batches of lines.
    """
    rng, features = np.random.default_rng(seed), Features()
    field = Field(np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS))
    field.step[OUTSIDE, INSIDE] = field.start[INSIDE] = -8.0  # no name goes on that has not begun
    seen = [np.full_like(x, 1e-2) for x in (field.node, field.step, field.start)]
    order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
    groups = [order[k : k + batch] for k in range(0, len(order), batch)]
    ids = [features.lines([lines[k] for k in group]) for group in groups]
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            group, own = groups[g], ids[g]
            sizes = np.array([len(lines[k]) for k in group])
            scores = padded(sizes.tolist(), field.node[own].sum(axis=1), 0.0)
            may = padded(sizes.tolist(), np.concatenate([allowed[k] for k in group]).astype(float), 1.0) > 0
            _, free, free_steps = marginals(field, scores, sizes)
            _, held, held_steps = marginals(field, np.where(may, scores, _NONE), sizes)
            inside = np.arange(len(scores))[:, None] < sizes
            miss = (free - held).transpose(1, 0, 2)[inside.T]  # one line after the other again
            node = np.zeros_like(field.node)
            np.add.at(node, own, miss[:, None, :])
            for x, grad, s in zip((field.node, field.step, field.start), (node, free_steps - held_steps, (free - held)[0].sum(axis=0)), seen):
                grad = grad / len(group) + decay * x * (grad != 0)
                s += grad**2
                x -= rate * grad / np.sqrt(s)
    return field


def names_in(field: Field, texts: list[str | None], scores: Scores | None = None) -> list[list[tuple[int, str]]]:
    """(place among the line's words, name) of each line's names."""
    scores = scores or Scores(field)
    out: list[list[tuple[int, str]]] = [[] for _ in texts]
    ends, at = np.cumsum([len(t or "") for t in texts]), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARACTERS, "right")))
        for k, found in zip(range(at, end), _names_in(field, [t or "" for t in texts[at:end]], scores)):
            out[k] = found
        at = end
    return out


def _names_in(field: Field, texts: list[str], scores: Scores) -> list[list[tuple[int, str]]]:
    distinct, numbers, counts = split_words(texts)
    values, firsts = scores.lines(distinct, numbers, counts), np.cumsum(counts) - counts
    out: list[list[tuple[int, str]]] = [[] for _ in texts]
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * counts[order[end]] <= WORDS:
            end += 1
        group, sizes = order[at:end], counts[order[at:end]]
        steps = np.arange(sizes[-1])[:, None]
        labels = viterbi(field, values.take(np.where(steps < sizes, firsts[group] + steps, 0), axis=0), sizes)
        # where a run of words inside a name, or of none, is over; labels beyond a line's end are outside
        columns, begins = np.nonzero(labels.T == BEGIN)
        stops, going = begins + 1, np.arange(len(begins))
        while len(going := going[stops[going] < len(labels)]) and len(going := going[labels[stops[going], columns[going]] == INSIDE]):
            stops[going] += 1
        for k, begin, stop in zip(group[columns].tolist(), begins.tolist(), stops.tolist()):
            out[k].append((begin, " ".join(distinct[w] for w in numbers[firsts[k] + begin : firsts[k] + stop])))
        at = end
    return out


def allowed_labels(words: list[str], phrases: list[tuple[int, int]], starts: list[int], small: set[str]) -> np.ndarray:
    """What each word of a line may be: of phrases (from, to) as characters names, of words that are not capitalised or
    are common in small letters nothing, of others anything."""
    may = np.ones((len(words), LABELS), dtype=bool)
    for k, (word, at) in enumerate(zip(words, starts)):
        if span := next((p for p in phrases if p[0] <= at < p[1]), None):
            may[k] = False
            may[k, BEGIN if at == span[0] else INSIDE] = True
        elif not word[:1].isupper() or len(word) < 3 or word.lower() in small:
            may[k] = [True, False, False]
    return may


def small_counts(lines: DataFrame) -> DataFrame:
    """``(word, n)`` of the words that lines write small, counted once for all that asks for them."""
    words = lines.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}])(\p{Ll}+)(?![\p{L}\p{N}])"), F.lit(1))).alias("word"))
    return cut(words.groupBy("word").agg(F.count("*").alias("n")))


def fit_on(lines: DataFrame, aliases: list[tuple[str, str]] | None = None, keys: list[str] = ["episode", "line_idx"], most: int = LINES, small_words: int = 20_000, counts: DataFrame | None = None) -> Field:  # noqa: B006
    """A field fitted on at most ``most`` lines, half of them with a phrase of the cast, in the order of their hashes.

    The ``small_words`` words of 3 to 20 letters that the lines write small most often count as common; ``counts`` are those of
    ``small_counts`` where a caller has them. What comes to the driver is bounded by these numbers and ``LONGEST`` words a line.
    """
    phrases = [a for a, _ in (aliases or fixed.alias_rows())]
    pattern = phrase_pattern(phrases)
    spoken = lines.filter(F.col("text").isNotNull() & (F.length("text") > 0))
    small = (small_counts(lines) if counts is None else counts).filter(F.length("word").between(3, 20))
    common = {r["word"] for r in zipfs(small).orderBy(F.desc("zipf"), "word").limit(small_words).collect() if r["zipf"] >= COMMON}
    some = cut(spoken.select(*keys, F.substring("text", 1, 12 * LONGEST).alias("text"), F.col("text").rlike(pattern).alias("has")))
    by = [F.xxhash64(*keys, "text"), F.col("text")]
    rows = [r["text"] for has in (True, False) for r in some.filter(F.col("has") == has).orderBy(*by).limit(most // 2).collect()]
    finder = re.compile("(?<![^\\W_])(?:" + "|".join(sorted(map(re.escape, set(phrases)), key=lambda p: (-len(p), p))) + ")(?![^\\W_])")
    words, may = [], []
    for text in rows:
        found = list(_WORD.finditer(text))[:LONGEST]
        if found:
            words.append([m[0] for m in found])
            may.append(allowed_labels(words[-1], [m.span() for m in finder.finditer(text)], [m.start() for m in found], common))
    return fit(words, may)


def model(field: Field) -> Callable[[DataFrame], DataFrame]:
    """lines -> proposed names (``at``, ``surface``), as ``mentions.extract`` asks of a model."""

    def propose(lines: DataFrame) -> DataFrame:
        shared = lines.sparkSession.sparkContext.broadcast(field)
        rows = lines.select([c for c in lines.columns if c != "text"] + ["text"])
        columns, schema = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", at int, surface string"

        def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = Scores(shared.value)
            for batch in batches:
                found = names_in(shared.value, batch.column(batch.num_columns - 1).to_pylist(), scores)
                of = np.repeat(np.arange(len(found)), list(map(len, found)))
                if len(of):
                    at, names = zip(*(x for own in found for x in own))
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in batch.columns), pa.array(at, pa.int32()), pa.array(names)], names=[*columns, "at", "surface"])

        return rows.mapInArrow(of_partition, schema)

    return propose


def agreement(found: DataFrame, cast: DataFrame, keys: list[str] = ["episode", "line_idx"]) -> DataFrame:  # noqa: B006
    """(precision, recall, f1) of found mentions against those of a cast, on the characters that the cast knows."""
    cut_to = lambda rows: rows.select(*keys, "character").distinct()
    known = cut_to(found.join(F.broadcast(cast.select("character").distinct()), "character", "left_semi"))
    both = known.withColumn("f", F.lit(1)).join(cut_to(cast).withColumn("c", F.lit(1)), [*keys, "character"], "full")
    hits = F.count(F.when(F.col("f").isNotNull() & F.col("c").isNotNull(), 1))
    out = both.agg(hits.alias("hits"), F.count("f").alias("n_found"), F.count("c").alias("n_cast"))
    return out.select((F.col("hits") / F.col("n_found")).alias("precision"), (F.col("hits") / F.col("n_cast")).alias("recall"), (2 * F.col("hits") / (F.col("n_found") + F.col("n_cast"))).alias("f1"))


"""Exact token counts at every prefix of a text, by prefix dynamic programming.

Counts inside a pre-token come from the dynamic programme of ``bpe.Vocabulary.prefix_counts``; what stands
before the pre-token adds its total. The few prefixes that end where more text changes the split (inside a
contraction, or after a space that a word takes to itself) are set apart, so that every entry is the count
that encoding the prefix alone would give. Truncation and budget questions are then searches in an array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import table

LIMIT = 1024
#: Pre-tokens that are laid out in one array at a time.
BLOCK = 1 << 16
#: Only next to these does more text change how what is before it splits.
UNEVEN = re.compile(r"\s\s|'")


class PrefixCounts:
    """Prefix counts for texts under one vocabulary; arrays of pre-tokens met before are kept, up to a bound."""

    def __init__(self, vocabulary: bpe.Vocabulary, most: int = 700_000) -> None:
        self.vocabulary = vocabulary
        self.known = bpe.Bounded(self._of_piece, most)

    def _of_piece(self, data: bytes) -> bytes:
        return np.array(self.vocabulary.prefix_counts(data), dtype=np.uint32).tobytes()

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """Counts after each byte of ``text``, in order, in arrays of bounded size where pre-tokens are.

        Entries inside a character count its bytes so far, as bytes.
        """
        base = 0
        for segment, special in bpe.segments(self.vocabulary, text):
            pieces, uneven = self.vocabulary.pieces(segment), bool(UNEVEN.search(segment))
            for at in range(0, len(pieces), BLOCK):
                some = pieces[at : at + BLOCK]
                parts = list(map(self.known.__getitem__, some))
                lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
                flat = np.frombuffer(b"".join(parts), dtype=np.uint32).astype(np.int64)
                ends = np.cumsum(lengths) - 1
                totals = flat[ends]
                before = base + np.cumsum(totals) - totals
                flat += np.repeat(before, lengths)
                if uneven:
                    self._mend(pieces, at, some, ends - lengths + 1, before, flat)
                base = int(before[-1] + totals[-1])
                yield flat
            if special is not None:
                name = self.vocabulary.tokens[special].decode()
                yield self._inside_special(pieces, base - self._total(pieces), name)
                base += 1

    def _total(self, pieces: list[str]) -> int:
        return sum(int.from_bytes(self.known[piece][-4:], "little") for piece in pieces)

    def _inside_special(self, pieces: list[str], base: int, name: str) -> np.ndarray:
        """Prefixes that end inside a special string see ordinary text there."""
        tail = "".join(pieces[-2:])
        fixed = base + self._total(pieces[:-2])
        counts = [fixed + self._total(self.vocabulary.pieces(tail + name[:k])) for k in range(1, len(name))]
        return np.array([*counts, base + self._total(pieces) + 1], dtype=np.int64)

    def _mend(self, pieces: list[str], at: int, some: list[str], starts: np.ndarray, before: np.ndarray, flat: np.ndarray) -> None:
        for k, piece in enumerate(some):
            head = piece[0]
            if head == "'" and len(piece) > 1 and piece[1].isalpha():
                # cut after the apostrophe, and where the contraction has two letters after the first of them
                if len(piece) == 3:
                    flat[starts[k] + 1] = before[k] + self._total(["'", piece[1]])
            elif head == " " and len(piece) > 1 and at + k and pieces[at + k - 1].isspace():
                # the space alone would belong to the run of spaces before it
                run = pieces[at + k - 1]
                flat[starts[k]] = before[k] - self._total([run]) + self._total([run + " "])
            elif head.isspace() and len(piece) == 1 and head != " " and at + k and pieces[at + k - 1].isspace():
                run = pieces[at + k - 1]
                flat[starts[k] + len(head.encode()) - 1] = before[k] - self._total([run]) + self._total([run + head])

    def every_prefix(self, text: str) -> np.ndarray:
        """Entry i: exact token count of the first i bytes, from 0 to all of them."""
        return np.concatenate([np.zeros(1, np.int64), *self.blocks(text)])


def budget_bytes(counts: np.ndarray, limit: int, text: bytes) -> int:
    """Bytes of the longest prefix of whole characters with at most ``limit`` tokens."""
    fits = np.flatnonzero(counts <= limit)
    for end in fits[::-1]:
        if end == len(text) or text[end] & 0xC0 != 0x80:
            return int(end)
    return 0


_known: dict[str, PrefixCounts] = {}


def prefix_counts(path: str) -> PrefixCounts:
    if path not in _known:
        _known[path] = PrefixCounts(bpe.load(path))
    return _known[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, fit_bytes; with ``with_prefixes`` the counts themselves.

    ``fit_bytes`` is the longest prefix, in bytes of whole characters, of at most ``limit`` tokens; ``prefix_counts``
    holds the count at every byte. Null texts count as empty. Rows are independent: nothing is shuffled. Ids of
    documents may be null or repeat, each row has its own result, other columns may have any name, and an empty
    table gives an empty table.
    """
    columns = [("doc_id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("over_limit", pa.bool_(), "boolean"), ("fit_bytes", pa.int64(), "long")]
    if with_prefixes:
        columns.append(("prefix_counts", pa.list_(pa.int64()), "array<long>"))

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                out = []
                for doc_id, value in zip(some.column(0).to_pylist(), some.column(1)):
                    text = value.as_py() or ""
                    size, last, fit, kept = 0, 0, 0, []
                    data = text.encode() if len(text) > limit else b""  # fewer bytes than the limit always fit
                    for counts in counter.blocks(text):
                        last = int(counts[-1])
                        if data and counts.min() <= limit < counts.max():
                            fits = np.flatnonzero(counts <= limit) + 1 + size
                            fit = next((int(end) for end in fits[::-1] if end == len(data) or data[end] & 0xC0 != 0x80), fit)
                        elif counts.max() <= limit:
                            fit = size + len(counts)
                        size += len(counts)
                        if with_prefixes:
                            kept.append(counts)
                    if data and fit < size and data[fit] & 0xC0 == 0x80:
                        fit = budget_bytes(counter.every_prefix(text), limit, data)
                    out.append((doc_id, size, last, last > limit, fit, *([np.concatenate(kept) if kept else []] if with_prefixes else [])))
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind, _) in zip(zip(*out), columns)], names=[name for name, _, _ in columns])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of_partition, ", ".join(f"{name} {kind}" for name, _, kind in columns))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), bpe.default_path())

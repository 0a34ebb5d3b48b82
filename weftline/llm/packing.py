"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import table
from weftline.session import cut

CAPACITY = 2048
OPEN_BINS = 256
#: Tokens of unfilled sequences, and 64 for each of their pieces, that one task packs again.
LEFT_TOKENS = 1 << 24
#: Numbers of the sequences that are packed again begin here.
AGAIN = 1 << 62
#: The id that ends every document.
END = 0
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """A fixed number of open bins, found by free space through a bitset.

    Bit f is set while some open bin has f places left. The bin with the least sufficient space takes an
    item, of equal ones the last used; if none has enough, a new bin opens, and where all may be open already the
    fullest closes first, of equal ones the last used. ``closed`` names the bins that the last item closed.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be at least 1")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = self.opened = self.open_now = 0
        self.closed: list[int] = []
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _pull(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes an item of ``length``, and the item's offset there."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item of {length} does not fit bins of {self.capacity}")
        self.closed = []
        if fits := self.bits >> length:
            space = length + (fits & -fits).bit_length() - 1
            found = self._pull(space)
        else:
            if length < self.capacity:
                if self.open_now == self.open_bins:
                    self.closed.append(self._pull((self.bits & -self.bits).bit_length() - 1))  # the fullest closes
                else:
                    self.open_now += 1
            space, found = self.capacity, self.opened
            self.opened += 1
            if length == space:
                self.closed.append(found)
                return found, 0
        if left := space - length:
            if not self.by_space[left]:
                self.bits |= 1 << left
            self.by_space[left].append(found)
        else:
            self.open_now -= 1
            self.closed.append(found)
        return found, self.capacity - space


def document_pieces(n_ids: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else full pieces after a shorter first one."""
    first = n_ids if n_ids <= capacity else n_ids % capacity or capacity
    yield 0, first
    for start in range(first, n_ids, capacity):
        yield start, capacity


def fast_encoder(path: str):
    """text -> uint32 ids equal to those of the tokenizers library for the vocabulary at ``path``.

    The vocabulary's ranks are its ids, so the rank encoder gives the same ids at several times the speed;
    a text that it refuses goes to the library.
    """
    import tiktoken

    vocabulary = bpe.load(path)
    special = set(vocabulary.special.values())
    ranks = {token: i for i, token in vocabulary.tokens.items() if i not in special}
    encoding = tiktoken.Encoding("ranks", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.special)

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except (ValueError, RuntimeError):
            return np.array(vocabulary.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        _encoders[path] = fast_encoder(path)
    return _encoders[path]


def _again(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """Pieces of unfilled sequences packed anew by the same rule, in the order of their former places."""
    some = [batch for batch in batches if batch.num_rows]
    if not some:
        return
    rows = pa.Table.from_batches(some).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    bins, base = BestFit(capacity, open_bins), AGAIN + (TaskContext.get().partitionId() << 40)
    places = np.array([bins.place(length) for length in rows["length"].to_pylist()], dtype=np.int64)
    for name, values in (("sequence_id", base + places[:, 0]), ("offset", places[:, 1])):
        rows = rows.set_column(rows.column_names.index(name), name, pa.array(values))
    yield from rows.combine_chunks().to_batches(max_chunksize=10_000)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False, left_tokens: int = LEFT_TOKENS) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    A document is its text's ids and a closing id 0; null and empty texts are that one id. Only documents
    above ``capacity`` are cut. ``with_ids`` adds the piece's ids. Ids of documents may be null or repeat, other
    columns may have any name, and an empty table gives an empty table.

    Every partition packs the stream of its own documents, in order and with ``open_bins`` open bins; what it
    holds is bounded by them. Bins that are open at its end, the least filled ones, are packed again by the same
    rule: their pieces meet by sequence in tasks of about ``left_tokens`` tokens (a piece counts 64 more, so short
    ones are bounded too), and those of many partitions share sequences. Only these pieces are shuffled. Both steps
    are written before they are read, so numbers of sequences stay as they are whatever reads them.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *([pa.list_(pa.int32())] if with_ids else []), pa.bool_()]
    names = [*(column.split()[0] for column in schema.split(", ")), "unfilled"]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, base = encoder(vocabulary), BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        end = np.array([END], dtype=np.uint32)

        def rows() -> Iterator[tuple]:
            held: dict[int, list[tuple]] = {}
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.concatenate([encode(text.as_py() or ""), end])
                    for piece, (start, length) in enumerate(document_pieces(len(ids), capacity)):
                        own = ids[start : start + length]
                        found, offset = bins.place(length)
                        more = (own.astype(np.int32),) if with_ids else ()
                        held.setdefault(found, []).append((doc_id, piece, start, length, zlib.crc32(own.astype("<u4").tobytes()), base + found, offset, *more))
                        for closed in bins.closed:
                            yield from ((*row, False) for row in held.pop(closed))
            for left in held.values():
                yield from ((*row, True) for row in left)

        for some in itertools.batched(rows(), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*some), types)], names=names)

    placed = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of_partition, f"{schema}, unfilled boolean"))
    filled, unfilled = placed.filter("not unfilled").drop("unfilled"), placed.filter("unfilled").drop("unfilled")
    size = unfilled.agg(F.sum(F.col("length") + 64)).first()[0] or 0
    tasks = max(-(-size // left_tokens), 1)
    return filled.union(cut(unfilled.repartition(tasks, "sequence_id").mapInArrow(lambda batches: _again(batches, capacity, open_bins), schema)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), bpe.default_path())

"""Alignment of the tokens of two tokenizers over the same bytes, by a dangling-suffix transducer.

Both token streams spell one byte string. The transducer takes the next token of the side that lies behind; its
state is which side leads and the bytes that the other has not matched yet, a suffix of the leader's last
token. Each step links the last tokens of both sides, and a group closes whenever no bytes dangle. Moves
are memoised by residual and next token.

Neither tokenizer carries anything over the start of white space that follows other characters, so texts are read in
stretches that begin there: both streams have a boundary, the transducer is in its empty state, and what
it made of a stretch is kept for the next time that the stretch comes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import table
from weftline.session import cut

#: Characters of text that are aligned at a time, and of stretches (or 16 for each) that are kept.
BLOCK, KEPT = 1 << 20, 1 << 24
#: Moves of the transducer that are kept.
MOVES = 1 << 20
#: Distinct pairs of ids that are broadcast at most (24 bytes each); beyond, pairs and counts meet by a shuffle.
PAIRS_AT_ONCE = 4_000_000
#: What stands for a space in pieces.
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"

_START = re.compile(r"(?<=\S)(?=[ \n])")
_UNEVEN = re.compile(r"\s[ \n]|\x00")


def stretches(text: str) -> list[str]:
    """``text`` cut before every space and line end that follows another character than white space."""
    if _UNEVEN.search(text):
        return _START.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """States are residuals with their leading side, numbered; odd ones where B leads, and 0 without residual."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.tokens = (a_bytes, b_bytes)
        self.names = [str(i) for i in range(max(len(a_bytes), len(b_bytes)))]
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers: dict[tuple[int, bytes], int] = {}
        # of state << 20 | token; the state says which side lies behind, and from state 0 A moves
        self.moves: dict[int, int] = {}

    def move(self, state: int, token: int) -> int:
        """The state after the next token of the side behind; -1 where its bytes are others than the residual's."""
        lead, residual = self.states[state >> 1]
        if not state:
            after = (0, self.tokens[0][token])
        else:
            own = self.tokens[1 - lead][token]
            if residual.startswith(own):
                after = (lead, residual[len(own) :])
            elif own.startswith(residual):
                after = (1 - lead, own[len(residual) :])
            else:
                return -1
        if not after[1]:
            return 0
        if after not in self.numbers:
            self.numbers[after] = 2 * len(self.states) + after[0]
            self.states.append(after)
        return self.numbers[after]

    def run(self, a: list[int], b: list[int], width: int, codes: list[int]) -> tuple[str, int] | None:
        """The groups of two streams as text, and their number; None if the streams do not spell the same bytes.

        The code ``id of A * width + id of B`` of each linked pair is appended to ``codes``.
        """
        if len(self.moves) > MOVES:
            self._forget()
        moves, names, link = self.moves, self.names, codes.append
        out, i, j, behind = [], 0, 0, len(codes)
        try:
            while i < len(a):
                x = a[i]
                i += 1
                own_a, own_b, state = names[x], "", moves.get(x)
                if state is None:
                    state = moves[x] = self.move(0, x)
                while state > 0:
                    if state & 1:
                        x = token = a[i]
                        i += 1
                        own_a += "," + names[x]
                    else:
                        y = token = b[j]
                        j += 1
                        own_b += "," + names[y]
                    link(x * width + y)
                    key = state << 20 | token
                    state = moves.get(key)
                    if state is None:
                        state = moves[key] = self.move(key >> 20, token)
                if state:
                    raise IndexError
                out.append(own_a + "|" + own_b[1:])
            if j < len(b):
                raise IndexError
        except IndexError:  # one side ends before the other, or spells something else
            del codes[behind:]
            return None
        return ";".join(out), len(out)


class Aligner:
    """Two tokenizers, their transducer, and the stretches that it has read."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self.a, self.b = bpe.ordinary_encoder(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        tokens = bpe.load(byte_path).tokens
        a_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.width = len(pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (a_bytes, b_bytes))
        self.b_bytes = b_bytes
        self.transducer = Transducer(a_bytes, b_bytes)
        # a piece with a space or line end behind another character would reach over the start of a stretch
        own = [x for i, x in enumerate(pieces) if not self.b.is_byte(i)]
        self.stretches = not any("\n" in x or SPACE in x.lstrip(SPACE) for x in own) and self._spelt("a") == b" a"
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.kept = 0
        self.texts: list[str | None] = []  # groups of the stretches, None where bytes differ
        self.sizes = np.zeros((1024, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.begins = np.zeros(1024, dtype=np.int64)  # of a stretch's codes
        self.codes, self.n_codes = np.zeros(4096, dtype=np.int64), 0

    def _spelt(self, text: str) -> bytes:
        return b"".join(map(self.b_bytes.__getitem__, self.b.encode(text)))

    def _keep(self, stretches: list[str], ids: list[tuple[list[int], list[int]]]) -> None:
        """Run the transducer over stretches, and keep what it made of them."""
        codes, sizes, begins, run, at = [], [], [], self.transducer.run, len(self.texts)
        for stretch, (a, b) in zip(stretches, ids):
            begins.append(self.n_codes + len(codes))
            made = run(a, b, self.width, codes)
            self.index[stretch] = len(self.texts)
            self.texts.append(made and made[0])
            sizes.append((len(a), len(b), made[1], self.n_codes + len(codes) - begins[-1]) if made else (0, 0, 0, 0))
            self.kept += len(stretch) + 16
        self.sizes, self.begins = _grown(self.sizes, len(self.texts)), _grown(self.begins, len(self.texts))
        self.codes = _grown(self.codes, self.n_codes + len(codes))
        self.sizes[at : len(self.texts)], self.begins[at : len(self.texts)] = sizes, begins
        self.codes[self.n_codes : self.n_codes + len(codes)] = codes
        self.n_codes += len(codes)

    def _read(self, new: list[str]) -> None:
        """Align stretches that are not kept. Those that follow each other without harm are encoded together."""
        # white space at a stretch's end would meet that of the next
        apart = [s for s in new if s[-1].isspace()]
        together = [s for s in new if not s[-1].isspace()] if apart else new
        if together:
            starts = 2 + np.cumsum([0, *(len(s.encode()) for s in together)])
            a, b = self._both(" a" + "".join(together))
            ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            at_a, at_b = np.searchsorted(ends_a, starts), np.searchsorted(ends_b, starts)
            if ends_a[-1] == starts[-1] == ends_b[-1] and (ends_a[at_a] == starts).all() and (ends_b[at_b] == starts).all():
                at_a, at_b = (at_a + 1).tolist(), (at_b + 1).tolist()
                self._keep(together, [(a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]]) for k in range(len(together))])
            else:
                apart = new
        for stretch in apart:
            a, b = self._both(" a" + stretch)
            skip_a, skip_b = (int(np.searchsorted(np.cumsum(sizes[ids]), 2)) + 1 for sizes, ids in ((self.a_sizes, a), (self.b_sizes, b)))
            self._keep([stretch], [(a[skip_a:], b[skip_b:])])

    def _both(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with a space, which B adds by itself."""
        return self.a(text), self.b.encode(text[1:])

    def _blocks(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = _START.search(text, min(at + BLOCK, len(text)))
            end = end.start() if end else len(text)
            some = stretches(text[at:end])
            yield some if some[0] else some[1:]  # a text begins with its space
            at = end

    def align(self, text: str | None, with_groups: bool = False) -> tuple[int, int, int, int, str, str | None, np.ndarray, np.ndarray]:
        """(tokens of A, of B, groups, links, sha256 of the groups, the groups, codes of linked pairs, times that each occurs)."""
        nothing = (0, 0, 0, 0, "", "" if with_groups else None, np.zeros(0, np.int64), np.zeros(0, np.int32))
        if not text or SPACE in text:  # U+2581 itself comes back as a space
            return nothing
        text = " " + text
        if not self.stretches:
            self._forget()
            self._keep([text], [self._both(text)])
        digest, spelt, totals, seen = hashlib.sha256(), [], np.zeros(4, np.int64), []
        for some in self._blocks(text) if self.stretches else [[text]]:
            if self.stretches:
                if self.kept > KEPT:
                    self._forget()
                if new := set(some).difference(self.index):
                    self._read(sorted(new))
            at = list(map(self.index.__getitem__, some))
            parts = list(map(self.texts.__getitem__, at))
            if None in parts:
                return nothing
            joined = ";" * bool(seen) + ";".join(parts)
            digest.update(joined.encode())
            if with_groups:
                spelt.append(joined)
            distinct, times = np.unique(np.array(at), return_counts=True)
            sizes = self.sizes[distinct]
            totals += times @ sizes
            links = sizes[:, 3]
            of = np.repeat(self.begins[distinct] - np.cumsum(links) + links, links) + np.arange(links.sum())
            seen.append(_summed(self.codes[of], np.repeat(times, links)))
        codes, times = seen[0] if len(seen) == 1 else _summed(*map(np.concatenate, zip(*seen)))
        return *totals.tolist(), digest.hexdigest(), "".join(spelt) if with_groups else None, codes, times.astype(np.int32)


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    """``x`` with room for ``size`` rows."""
    return x if len(x) >= size else np.concatenate([x, np.zeros((max(size, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    begins = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[begins], np.add.reduceat(times, begins) if len(begins) else times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    key = (byte_path, piece_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Every document's aligned tokens: ``COLUMNS``, its distinct linked pairs as ``codes`` (id of A times the pieces of
    B, and id of B) with the ``times`` each occurs, and a number ``row``. ``with_groups`` adds the groups as text.

    A text that is null, empty, or that a side does not spell (U+2581 reads as a space) has no tokens. Whole
    texts are aligned, block by block, so that a long one holds no more than its own text and its distinct pairs.
    """
    schema = f"row long, {COLUMNS}, codes array<long>, times array<int>" + (", groups string" if with_groups else "")

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            done, size = [], 0

            def rows() -> pa.RecordBatch:
                n_a, n_b, n_groups, n_links, digests, groups, codes, times = zip(*done)
                ends = np.cumsum([0, *map(len, codes)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (codes, times)]
                numbers = pa.array(np.arange(row, row + len(done)))
                own = batch.column(0).slice(at + 1 - len(done), len(done))
                columns = [numbers, own, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(digests), *lists]
                return pa.RecordBatch.from_arrays([*columns, *([pa.array(groups, pa.string())] if with_groups else [])], names=names)

            for at, text in enumerate(batch.column(1)):
                done.append(both.align(text.as_py(), with_groups))
                size += len(done[-1][-1]) + len(done[-1][5] or "")
                if size > BLOCK or at + 1 == batch.num_rows:
                    yield rows()
                    row += len(done)
                    done, size = [], 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of_partition, schema)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """Per document, repeated ones too: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair of ids counts in as many documents (rows) as hold it linked. ``n_best`` are the links whose count is the
    highest of their id of A, ties included; ``count_sum`` adds the counts of all links. Documents are
    tokenised once: their pairs are written to the shared folder, counted with a sum in each task before the
    shuffle, and read again. Counts are broadcast up to ``pairs_at_once`` distinct pairs, a checked number;
    beyond, exploded pairs meet them by a join. Ids may be null or repeat, other columns may have any name,
    and an empty table gives an empty table. Null and empty texts, and those that a side does not spell, have
    zeros and the digest ''.
    """
    spark = docs.sparkSession
    aligned = cut(token_groups(docs, byte_path, piece_path, id_col, text_col))
    counts = cut(aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n_docs")))
    width = _pieces(piece_path)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() > pairs_at_once:
        best = counts.groupBy(F.expr(f"code div {width}").alias("a")).agg(F.max("n_docs").alias("most"))
        known = counts.withColumn("a", F.expr(f"code div {width}")).join(best, "a").select("code", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
        links = aligned.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", "x.codes", "x.times")
        found = links.join(known, links["codes"] == known["code"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
        none = F.lit(0).cast("long")
        return aligned.join(found, "row", "left").withColumns({x: F.coalesce(F.col(x).cast("long"), none) for x in ("n_best", "count_sum")}).select(*out)

    held = counts.sort("code").toArrow()
    codes, n_docs = (held[x].to_numpy() for x in ("code", "n_docs"))
    begins = np.flatnonzero(np.diff(codes // width, prepend=-1))
    most = np.repeat(np.maximum.reduceat(n_docs, begins), np.diff(begins, append=len(codes))) if len(codes) else n_docs
    shared = spark.sparkContext.broadcast((codes, n_docs, n_docs == most))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n_docs, best = shared.value
        for batch in batches:
            own, times = batch.column("codes"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(codes, own.flatten().to_numpy())
            lengths = own.value_lengths().fill_null(0).to_numpy()
            of = np.repeat(np.arange(batch.num_rows), lengths)
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(sums[0], of, times * best[at])
            np.add.at(sums[1], of, times * n_docs[at])
            rest = {x: batch.column(x) for x in out if x in batch.schema.names}
            rest |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays([rest[x] for x in out], names=out)

    return aligned.drop("row").mapInArrow(scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), bpe.default_path(), default_piece_path())

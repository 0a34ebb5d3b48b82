"""BPE encoding and decoding as streams with constant memory.

The encoder takes a text in parts of any size. Special strings, then pre-tokens, then merges each hold back
only what more text could change: a possible beginning of a special string, the last pre-token (two where
an apostrophe may begin a contraction), and inside a pre-token of any length the merge list's sufficient
lookahead. What is before that is stable and leaves at once.
"""

from __future__ import annotations

import codecs
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import table

#: Bytes of one pre-token that are merged at a time, besides the lookahead.
BLOCK = 1 << 13
#: Characters of a text that are handed to the encoder at a time.
PART = 1 << 18
RUNS = {kind: regex.compile(pattern) for kind, pattern in (("letters", r"\p{L}+"), ("numbers", r"\p{N}+"), ("spaces", r"\s+"), ("others", r"[^\s\p{L}\p{N}]+"))}


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("no 32-bit array type")
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Merger:
    """Merges one pre-token whose bytes come in parts; ``feed`` gives the ids that are stable."""

    def __init__(self, vocabulary: bpe.Vocabulary, block: int = BLOCK) -> None:
        self.vocabulary, self.block, self.held = vocabulary, block, b""

    def feed(self, data: bytes) -> Iterator[int]:
        lookahead = self.vocabulary.lookahead
        at = 0
        while at < len(data):
            room = self.block + lookahead - len(self.held)
            self.held += data[at : at + room]
            at += room
            if len(self.held) < self.block + lookahead:
                return
            stable, limit = 0, len(self.held) - lookahead
            for i in self.vocabulary.merge(self.held):
                if stable + len(self.vocabulary.tokens[i]) > limit:
                    break
                stable += len(self.vocabulary.tokens[i])
                yield i
            self.held = self.held[stable:]

    def finish(self) -> Iterator[int]:
        yield from self.vocabulary.merge(self.held)
        self.held = b""


class Encoder:
    """``feed`` parts of a text, then ``finish``: each gives the packed ids that have become stable."""

    def __init__(self, vocabulary: bpe.Vocabulary, known: dict[str, bytes] | None = None, block: int = BLOCK) -> None:
        self.vocabulary, self.block = vocabulary, block
        self.known = bpe.Bounded(lambda piece: packed(vocabulary.merge(piece))) if known is None else known
        self.text = self.rest = ""  # before the search for special strings; before the split
        self.run: str | None = None  # the kind of a pre-token of which a part has left
        self.merger = Merger(vocabulary, block)
        self.longest = max(map(len, vocabulary.special), default=1)

    def feed(self, text: str) -> Iterator[bytes]:
        self.text += text
        at = 0
        while self.vocabulary.cut and (found := self.vocabulary.cut.search(self.text, at)):
            yield from self._split(self.text[at : found.start()])
            yield from self._end_of_segment()
            yield packed([self.vocabulary.special[found.group()]])
            at = found.end()
        hold = next((k for k in range(min(self.longest - 1, len(self.text) - at), 0, -1) if any(s.startswith(self.text[len(self.text) - k :]) for s in self.vocabulary.special)), 0)
        until = len(self.text) - hold
        part, self.text = self.text[at:until], self.text[until:]
        yield from self._split(part)

    def finish(self) -> Iterator[bytes]:
        part, self.text = self.text, ""
        yield from self._split(part)
        yield from self._end_of_segment()

    def _split(self, text: str) -> Iterator[bytes]:
        self.rest += text
        if self.run:
            yield from self._go_on()
            if self.run:
                return
        pieces = self.vocabulary.pieces(self.rest)
        if not pieces:
            return
        last = pieces.pop()
        if pieces and pieces[-1] == "'":
            last = pieces.pop() + last
        if len(pieces) == 1:
            yield self.known[pieces[0]]
        elif pieces:
            yield b"".join(map(self.known.__getitem__, pieces))
        self.rest = last
        if len(last) > max(self.block, 8) and self.vocabulary.pieces(last) == [last]:  # longer than any contraction
            body = last[1:] if last[0] == " " else last
            self.run = self._kind(body[0])
            keep = -1 if self.run == "spaces" else len(last)  # the last space may belong to a word
            self.rest = last[keep:]
            yield packed(self.merger.feed(last[:keep].encode()))

    def _kind(self, character: str) -> str:
        """The kind of run that the splitter takes a character for."""
        stand_ins = {"letters": "a", "numbers": "1", "others": "!"}
        return next((kind for kind, x in stand_ins.items() if len(self.vocabulary.pieces(x + character)) == 1), "spaces")

    def _go_on(self) -> Iterator[bytes]:
        """More of a pre-token that is longer than a block."""
        if bpe.RARE.search(self.rest):  # the library decides, character by character
            own = next((k for k, x in enumerate(self.rest) if self._kind(x) != self.run), len(self.rest))
        else:
            found = RUNS[self.run].match(self.rest)
            own = found.end() if found else 0
        ends = own < len(self.rest)
        if self.run == "spaces":
            own = max(0, own - 1)
        part, self.rest = self.rest[:own], self.rest[own:]
        yield packed(self.merger.feed(part.encode()))
        if ends:
            self.run = None
            yield packed(self.merger.finish())

    def _end_of_segment(self) -> Iterator[bytes]:
        if self.run:
            yield packed(self.merger.feed(self.rest.encode()))
            yield packed(self.merger.finish())
        elif self.rest:
            yield b"".join(map(self.known.__getitem__, self.vocabulary.pieces(self.rest)))
        self.rest, self.run = "", None


class Decoder:
    """Packed ids to text, part by part; bytes that end inside a character wait for the next part."""

    def __init__(self, vocabulary: bpe.Vocabulary) -> None:
        self.tokens = vocabulary.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


_known: dict[str, dict[str, bytes]] = {}


def known_pieces(path: str) -> dict[str, bytes]:
    """Packed ids of pre-tokens met before, one table of bounded size for each Python worker."""
    if path not in _known:
        vocabulary = bpe.load(path)
        _known[path] = bpe.Bounded(lambda piece: packed(vocabulary.merge(piece)), most=500_000)
    return _known[path]


def encode_stream(text: str, vocabulary: bpe.Vocabulary, known: dict[str, bytes], part: int = PART) -> Iterator[bytes]:
    encoder = Encoder(vocabulary, known)
    for at in range(0, len(text), part):
        yield from encoder.feed(text[at : at + part])
    yield from encoder.finish()


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_outputs: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_outputs`` also ids and decoded text.

    Every whole text is encoded, then decoded from its ids. Null texts count as empty. Rows are independent:
    nothing is shuffled, and ids and text are hashed part by part as they leave the transducers. Ids of documents may
    be null or repeat, each row has its own result, other columns may have any name, and an empty table gives an
    empty table.
    """
    columns = [("doc_id", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    if with_outputs:
        columns += [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, known = bpe.load(vocabulary), known_pieces(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                out: list[tuple] = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids_hash, text_hash, decoder, size = hashlib.sha256(), hashlib.sha256(), Decoder(loaded), 0
                    ids_out, text_out = [], []
                    for ids in encode_stream(text.as_py() or "", loaded, known):
                        size += len(ids) // 4
                        ids_hash.update(ids)
                        decoded = decoder.feed(ids)
                        text_hash.update(decoded.encode())
                        if with_outputs:
                            ids_out += memoryview(ids).cast("I").tolist()
                            text_out.append(decoded)
                    decoded = decoder.finish()
                    text_hash.update(decoded.encode())
                    out.append((doc_id, size, ids_hash.hexdigest(), text_hash.hexdigest(), *([ids_out, "".join(text_out) + decoded] if with_outputs else [])))
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind, _) in zip(zip(*out), columns)], names=[name for name, _, _ in columns])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of_partition, ", ".join(f"{name} {kind}" for name, _, kind in columns))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), bpe.default_path())

"""Byte-level BPE vocabularies: loading, merging, sufficient lookahead, prefix dynamic programming.

A vocabulary is a JSON file of the tokenizers library. Its path is a parameter, read where the work runs.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import regex

# Fixed values of byte-level BPE: the pre-tokenizer's pattern, and its printable stand-ins for bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

SPLIT = regex.compile(PATTERN)
#: Outside these ranges the classes \p{L}, \p{N} and \s may differ between Unicode versions.
RARE = regex.compile("[^\x00-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԯ -⁤ぁ-ゖァ-ヺ一-龥가-힣]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Tokens by id, merges by pair of ids, and the special strings that texts are cut at."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        rest = iter(range(256, 512))
        byte_of = {chr(b if b in PRINTABLE else next(rest)): b for b in range(256)}
        ids: dict[str, int] = model["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(map(byte_of.__getitem__, name)) for name, i in ids.items()}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: name.encode() for name, i in self.special.items()}
        self.byte_ids = [0] * 256
        for name, byte in byte_of.items():
            self.byte_ids[byte] = ids[name]
        #: (left id << 20 | right id) -> rank << 20 | id of the merged token
        self.merges: dict[int, int] = {}
        self.merge_list: list[bytes] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault(ids[left] << 20 | ids[right], rank << 20 | ids[left + right])
            self.merge_list.append(self.tokens[ids[left + right]])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.library = Tokenizer.from_file(path)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, as the library splits it."""
        if text.isascii() or not RARE.search(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank merges first, from the left, until none is left."""
        ids = list(map(self.byte_ids.__getitem__, data))
        if len(ids) > 200:
            return self._merge_long(ids)
        get, none = self.merges.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            ids[at : at + 2] = [new := least & 0xFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, none)
            if at < len(ranks):
                ranks[at] = get(new << 20 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n for runs of any length."""
        import heapq

        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m >> 20, i, ids[i], ids[i + 1], m & 0xFFFFF) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (m >> 20, a, ids[a], ids[b], m & 0xFFFFF))
        return [x for x in ids if x >= 0]

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes to the right of a token boundary beyond which no text can move it.

        When more text changes a token, a merge of lower rank took its last bytes; what that frees lets
        another merge, of higher rank than the one undone, reach over to the left, and so on. Tokens on
        such a way overlap, and ranks rise strictly towards the left, so the longest way over overlapping
        merges of falling rank bounds how far a change can travel.
        """
        reach_by_prefix: dict[bytes, int] = {}
        most = max(map(len, self.tokens.values()))
        for token in self.merge_list:
            reach = len(token)
            for k in range(1, len(token)):
                reach = max(reach, k + reach_by_prefix.get(token[k:], 0))
            most = max(most, reach)
            for k in range(1, len(token)):
                head = token[:k]
                reach_by_prefix[head] = max(reach_by_prefix.get(head, 0), reach)
        return most

    # -- prefix dynamic programming

    @functools.cached_property
    def _by_bytes(self) -> dict[bytes, int]:
        """Ids by bytes, of the tokens that their own bytes encode to; no other token is ever used."""
        return {token: i for i, token in self.tokens.items() if i not in self.special.values() and self.merge(token) == [i]}

    @functools.cached_property
    def _heads(self) -> set[bytes]:
        return {token[:k] for token in self._by_bytes for k in range(len(token) + 1)}

    @functools.cached_property
    def _states(self) -> tuple[dict[int, int], list[bytes], list[tuple[tuple[int, int], ...]], dict[bytes, int]]:
        """An automaton grown as texts need it: steps, and by state its bytes and the tokens that end there."""
        return {}, [b""], [()], {b"": 0}

    def _step(self, state: int, byte: int) -> int:
        steps, names, ending, numbers = self._states
        name = names[state] + bytes([byte])
        while name not in self._heads:
            name = name[1:]
        if (found := numbers.get(name)) is None:
            found = numbers[name] = len(names)
            names.append(name)
            ending.append(tuple((len(name) - k, token) for k in range(len(name)) if (token := self._by_bytes.get(name[k:])) is not None))
        steps[state << 8 | byte] = found
        return found

    @functools.cached_property
    def _stands(self) -> dict[int, bool]:
        return {}

    def _pair_stands(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        if len(self._stands) > 400_000:
            self._stands.clear()
        found = self._stands[left << 20 | right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def prefix_counts(self, data: bytes) -> list[int]:
        """Entry i: exact token count of the first i+1 bytes of a pre-token, each prefix taken as a whole.

        A prefix's encoding is the encoding of a shorter prefix and one more token, and that token is the one
        that stands beside the last token of the shorter prefix. Last tokens therefore suffice as states.
        """
        steps, _, ending, _ = self._states
        stands = self._stands
        last: list[int] = []
        counts: list[int] = []
        state = 0
        for end, byte in enumerate(data, 1):
            key = state << 8 | byte
            state = steps[key] if key in steps else self._step(state, byte)
            for length, token in ending[state]:
                if length == end:
                    last.append(token)
                    counts.append(1)
                    break
                left = last[end - length - 1]
                key = left << 20 | token
                if stands[key] if key in stands else self._pair_stands(left, token):
                    last.append(token)
                    counts.append(counts[end - length - 1] + 1)
                    break
        return counts


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """One vocabulary for each path and Python worker."""
    return Vocabulary(path)


def ordinary_encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizers library for the vocabulary at ``path``, special strings read as plain text.

    The vocabulary's ranks are its ids, so the rank encoder gives the same ids faster; a text that it refuses
    goes to the library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    vocabulary, library = load(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    special = set(vocabulary.special.values())
    ranks = tiktoken.Encoding("ordinary", pat_str=PATTERN, mergeable_ranks={token: i for i, token in vocabulary.tokens.items() if i not in special}, special_tokens={})

    def encode(text: str) -> list[int]:
        try:
            return ranks.encode_ordinary(text)
        except (ValueError, RuntimeError):
            return library.encode(text, add_special_tokens=False).ids

    return encode


class Bounded(dict):
    """A mapping from pre-tokens to what ``make`` gives, emptied whenever it holds ``most`` entries."""

    def __init__(self, make, most: int = 300_000, longest: int = 64) -> None:
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece: str):
        made = self.make(piece.encode("utf-8", "replace"))
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = made
        return made


def segments(vocabulary: Vocabulary, text: str) -> Iterator[tuple[str, int | None]]:
    """The text between special strings, and the id of the special string that follows (None at the end)."""
    at = 0
    for found in vocabulary.cut.finditer(text) if vocabulary.cut else ():
        yield text[at : found.start()], vocabulary.special[found.group()]
        at = found.end()
    yield text[at:], None

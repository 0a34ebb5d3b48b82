"""Alignment of two tokenizers against a plain version over byte positions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import alignment, bpe

PATHS = (bpe.default_path(), alignment.default_piece_path())
LIBRARY = Tokenizer.from_file(PATHS[0])
LIBRARY.encode_special_tokens = True
ODD = [*" \n\t\r \n\n'’.,!ab Zé1 9ß<>|▁  　\x1c\x1f\x85​᠎한中😀́ﬁ\x00", "the", " and", "'s", "'ll", "{\r", "  ", "<|endoftext|>", "<s>", "<0x41>", "\r\n", "▁▁", "ing"]


@pytest.fixture(scope="module")
def both():
    return alignment.aligner(*PATHS)


def plain(both, text):
    """(n_a, n_b, n_groups, n_links, digest, {code: times}) from the ends of whole encodings."""
    if not text:
        return 0, 0, 0, 0, "", {}
    a, b = LIBRARY.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    spelt = [[side[x] for x in ids] for side, ids in zip(both.transducer.tokens, (a, b))]
    if any(b"".join(x) != (" " + text).encode() for x in spelt):
        return 0, 0, 0, 0, "", {}
    ends = [np.cumsum([len(x) for x in side]) for side in spelt]
    groups, at = [], [0, 0]
    for end in sorted({*ends[0].tolist()} & {*ends[1].tolist()}):
        upto = [int(np.searchsorted(x, end)) + 1 for x in ends]
        groups.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
        at = upto
    links = Counter()
    starts = [np.concatenate(([0], x[:-1])) for x in ends]
    for i, x in enumerate(a):
        for j in np.flatnonzero((starts[1] < ends[0][i]) & (ends[1] > starts[0][i])):
            links[x * both.width + b[j]] += 1
    spelt = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(spelt.encode()).hexdigest(), dict(links)


def held(both, text):
    made = both.align(text)
    return *made[:5], dict(zip(made[6].tolist(), made[7].tolist()))


def test_odd_texts_equal_the_plain_version(both, monkeypatch):
    rng = random.Random(3)
    assert both.stretches
    for n in range(1500):
        monkeypatch.setattr(alignment, "BLOCK", rng.choice([5, 20, 1 << 20]))
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        assert held(both, text) == plain(both, text), repr(text)


def test_kept_stretches_may_be_forgotten_at_any_time(both, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 60)
    monkeypatch.setattr(alignment, "MOVES", 8)
    for text in ("one two one three two", "a b c d e f g\nh" * 5, "Wörter, die enden"):
        assert held(both, text) == plain(both, text)


def test_whole_texts_where_stretches_would_not_do(both, monkeypatch):
    monkeypatch.setattr(both, "stretches", False)
    assert held(both, "one two\n three") == plain(both, "one two\n three")


def test_transducer_refuses_streams_of_other_bytes():
    machine = alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x"])
    codes = []
    assert machine.run([0, 1], [0, 1], 3, codes) == ("0,1|0,1", 1) and codes == [0, 1, 4]
    assert machine.run([2], [0, 1], 3, codes) == ("2|0,1", 1)
    before = list(codes)
    for a, b in (([0], [0]), ([0], [0, 2]), ([], [0]), ([0, 1, 1], [0, 1]), ([1], [2])):
        assert machine.run(a, b, 3, codes) is None and codes == before
    assert machine.run([], [], 3, codes) == ("", 0)


def test_long_text_in_blocks(both):
    text = "some words, repeated\nover lines " * 40_000
    whole = both.align(text, with_groups=True)
    assert whole[0] > 200_000 and whole[5].count(";") == whole[2] - 1 and hashlib.sha256(whole[5].encode()).hexdigest() == whole[4]
    assert held(both, text[:3_000]) == plain(both, text[:3_000])


ROWS = [(1, "Cross the tokens, cross them."), (2, ""), (3, None), (None, "the tokens"), (2, "the tokens"), (2, "the tokens"), (5, "with ▁ in it"), (6, "x" * 5000), (7, "tokens tokens\n\n tokens ")]


@pytest.mark.parametrize("pairs", [0, alignment.PAIRS_AT_ONCE])
def test_counts_over_all_documents(spark, both, pairs):
    docs = spark.createDataFrame([(*row, 1, "y") for row in ROWS], "doc_id long, text string, row long, n_best string").repartition(3)
    known = [(i, plain(both, text)) for i, text in ROWS]
    counts = Counter(code for _, x in known for code in x[5])
    most = {}
    for code, n in counts.items():
        most[code // both.width] = max(n, most.get(code // both.width, 0))
    expected = sorted(((i, *x[:4], sum(t for c, t in x[5].items() if counts[c] == most[c // both.width]), sum(t * counts[c] for c, t in x[5].items()), x[4]) for i, x in known), key=str)
    out = alignment.align(docs, *PATHS, pairs_at_once=pairs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == expected
    assert sorted(map(tuple, alignment.align(docs.limit(0), *PATHS, pairs_at_once=pairs).collect())) == []


def test_groups_as_text(spark, both):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for r in alignment.token_groups(docs, *PATHS, with_groups=True).collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "")
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]

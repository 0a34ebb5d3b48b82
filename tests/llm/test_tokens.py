import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import bpe, packing, token_counts, transducer

PARTS = ["a", "b", "th", " ", "  ", "\n", "ththththth", "----------", "        ", "\n\n\n\n\n\n\n\n\n", "222222222222", "'", "'ll", "'re", "'s", " '", "é", "1", "!", "<|endoftext|>", "<|endo", "|>", "Ա", "՘", "中", "\U0003fc3b", "\t", "the", "\xa0"]
EDGES = [None, "", " ", "plain text", "x<|endoftext|>y", "é" * 9000, "word " * 4000, "a" * 20000, "\n" * 5000]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(bpe.default_path())


def library_ids(vocabulary, text):
    return array("I", vocabulary.library.encode(text or "", add_special_tokens=False).ids)


def made(seed, n, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def encoded(vocabulary, text, cuts=(), block=transducer.BLOCK):
    encoder, out, at = transducer.Encoder(vocabulary, None, block), [], [0, *sorted(cuts), len(text)]
    for a, b in zip(at, at[1:]):
        out += encoder.feed(text[a:b])
    return b"".join([*out, *encoder.finish()])


def test_stream_equals_library_for_any_parts_and_blocks(vocabulary):
    rng = random.Random(8)
    for text in made(1, 1500):
        cuts = [rng.randint(0, len(text)) for _ in range(rng.randint(0, 4))]
        want = library_ids(vocabulary, text).tobytes()
        assert encoded(vocabulary, text, cuts) == want == encoded(vocabulary, text, cuts, 2), text


@pytest.mark.parametrize("unit", ["a", "th", "é", " ", "\n", "-=", "1", "中", "erentthe", "Ա"])
def test_long_runs_stream_and_decode(vocabulary, unit):
    text = f"x {unit * (20000 // len(unit))} y'll{unit * 3000} "
    want = library_ids(vocabulary, text).tobytes()
    assert encoded(vocabulary, text, [5, 7777, 9000], 300) == want
    decoder = transducer.Decoder(vocabulary)
    assert "".join(decoder.feed(want[i : i + 28]) for i in range(0, len(want), 28)) + decoder.finish() == text


def test_state_stays_small(vocabulary):
    encoder = transducer.Encoder(vocabulary, None, 1000)
    for _ in range(50):
        for _ in encoder.feed("ab" * 2000):
            pass
        assert len(encoder.merger.held) <= 1000 + vocabulary.lookahead and len(encoder.rest) <= 5000


def test_rare_characters_are_split_by_the_library(vocabulary):
    for code in [*range(0, 0x3000), *range(0x4E00, 0xA000, 97), *range(0xA000, 0x30000, 31)]:
        if not 0xD800 <= code <= 0xDFFF:
            text = f"a{chr(code)}b {chr(code)}1{chr(code)}{chr(code)} ?{chr(code)}  {chr(code)}"
            assert vocabulary.pieces(text) == [text[a:b] for _, (a, b) in vocabulary.library.pre_tokenizer.pre_tokenize_str(text)], hex(code)


def test_round_trip_query(spark, vocabulary):
    texts = [*EDGES, *made(3, 60)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = {r["doc_id"]: r for r in transducer.round_trip(rows, bpe.default_path(), with_outputs=True).collect()}
    for i, text in enumerate(texts):
        ids = library_ids(vocabulary, text)
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids"] == ids.tolist() and out[i]["decoded"] == (text or "")
        assert out[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert transducer.round_trip(rows.limit(0), bpe.default_path()).count() == 0


def test_every_prefix_has_the_count_of_encoding_it_alone(vocabulary):
    counter = token_counts.PrefixCounts(vocabulary)
    for text in made(2, 400, 12):
        counts = counter.every_prefix(text)
        assert len(counts) == len(text.encode()) + 1
        for i in range(len(text) + 1):
            assert counts[len(text[:i].encode())] == len(library_ids(vocabulary, text[:i])), (text, i)


def test_token_count_query(spark, vocabulary):
    texts = [*EDGES, *made(5, 60)]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    out = {r["doc_id"]: r for r in token_counts.token_counts(rows, bpe.default_path(), limit=9).collect()}
    for i, text in enumerate(texts):
        n = len(library_ids(vocabulary, text))
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((text or "").encode()), n, n > 9)
        best = max((len((text or "")[:k].encode()) for k in range(min(200, len(text or "")) + 1) if len(library_ids(vocabulary, (text or "")[:k])) <= 9), default=0)
        if len(text or "") <= 200:
            assert out[i]["fit_bytes"] == best, text


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 5, 9, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0)]
    assert bins.place(6) == (5, 0) and bins.place(5) == (2, 5)  # bin 3 (one place left) has closed for bin 5
    with pytest.raises(ValueError):
        bins.place(11)


def test_packing_invariants(spark, vocabulary):
    texts = [*EDGES, *made(9, 200)]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    out = packing.pack(rows, bpe.default_path(), capacity=64, open_bins=4, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = [x for r in pieces for x in r["ids"]]
        assert ids == [*library_ids(vocabulary, text), 0]
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        assert len(pieces) == 1 or all(r["length"] == 64 for r in pieces[1:])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces)
    for items in by_sequence.values():
        items.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in items] == list(np.cumsum([0, *(r["length"] for r in items)])[:-1])
        assert sum(r["length"] for r in items) <= 64
    full = sum(r["length"] for r in out) / 64
    assert len(by_sequence) <= full * 1.15 + 3 * 4
    assert packing.pack(rows.limit(0), bpe.default_path()).count() == 0


def test_second_step_places_by_the_same_rule_in_former_order(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    rows = [{"doc_id": k, "piece": 0, "start": 0, "length": rng.randint(1, 40), "ids_crc32": k, "sequence_id": k // 3, "offset": k % 3} for k in range(500)]
    bins = packing.BestFit(64, 4)
    expected = {r["doc_id"]: bins.place(r["length"]) for r in rows}
    rng.shuffle(rows)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("", (), {"partitionId": lambda self: 2})())
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in packing.SCHEMA.split(", ")])
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 90], schema) for k in range(0, 500, 90)]
    out = pa.Table.from_batches(packing._again(iter(batches), 64, 4)).to_pylist()
    assert {r["doc_id"]: (r["sequence_id"] - packing.AGAIN - (2 << 40), r["offset"]) for r in out} == expected


def test_unfilled_sequences_are_packed_again(spark):
    # 24 partitions of few documents: one by one they would leave nearly every sequence unfilled
    rows = spark.range(0, 720, 1, 24).selectExpr("if(id % 7 = 0, null, id) doc_id", "repeat(' word', cast(id * 37 % 90 as int)) text", "id sequence_id")
    total = 720 + sum(i * 37 % 90 for i in range(720))
    for left in (1 << 24, 20_000):
        out = packing.pack(rows, bpe.default_path(), capacity=256, left_tokens=left).collect()
        held = defaultdict(list)
        for r in out:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(out) == 720 and sum(r["length"] for r in out) == total
        for items in held.values():
            items.sort()
            assert [at for at, _ in items] == list(np.cumsum([0, *(n for _, n in items)])[:-1]) and sum(n for _, n in items) <= 256
        tasks = -(-(total + 64 * 720) // left)
        assert len(held) <= -(-total // 256) + 2 * tasks


def test_placement_agrees_with_a_plain_list_of_bins():
    # the open bins as a list of [number, space], the last used first among equals; the fullest closes first
    rng = random.Random(12)
    for capacity, most in ((50, 3), (50, 8), (17, 1), (200, 40)):
        bins, opened, packing_ = [], 0, packing.BestFit(capacity, most)
        for _ in range(3000):
            length = rng.choice((1, capacity, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4))))
            fits = [b for b in bins if b[1] >= length]
            if fits:
                space = min(b[1] for b in fits)
                chosen = [b for b in fits if b[1] == space][-1]
                bins.remove(chosen)
            else:
                if length < capacity and len(bins) == most:
                    fullest = min(b[1] for b in bins)
                    bins.remove([b for b in bins if b[1] == fullest][-1])
                chosen, opened = [opened, capacity], opened + 1
            assert packing_.place(length) == (chosen[0], capacity - chosen[1])
            if chosen[1] - length:
                bins.append([chosen[0], chosen[1] - length])


def test_null_and_repeated_ids_and_names_that_clash(spark):
    rows = [(None, "two words"), (None, None), (3, "two words"), (3, "two words"), (3, "other"), (4, "")]
    docs = spark.createDataFrame([(*r, 7, "x", True) for r in rows], "doc_id long, text string, n_tokens long, ids_sha256 string, over_limit boolean")
    for run in (transducer.round_trip, token_counts.token_counts):
        out = run(docs, bpe.default_path())
        counts = sorted((str(r["doc_id"]), r["n_tokens"]) for r in out.collect())
        assert counts == [("3", 1), ("3", 2), ("3", 2), ("4", 0), ("None", 0), ("None", 2)]
        assert run(docs.limit(0), bpe.default_path()).count() == 0

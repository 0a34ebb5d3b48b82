import hashlib
import math
import zlib

from weftline.llm import sharding


def winner(key, weights):
    draw = lambda k: (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 1) / 2**52
    return min((k for k, w in enumerate(weights) if w), key=lambda k: -math.log(draw(k)) / weights[k])


def test_law_slots_and_growth(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED_ROWS", 7)
    rows = [(i % 500, f"text {i % 40}" if i % 9 else None, "x", i) for i in range(1500)] + [(None, "é", "x", 0), (None, None, "y", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    out = sharding.assign_shards(frame).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], sharding.SHARDS)
        assert r["shard"] == winner("null" if r["doc_id"] is None else r["doc_id"], [1.0] * 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((d if d is not None else -1), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["size"], r["text_crc32"]) for r in out) == want


def test_weights_decide_shares(spark):
    weights = (1.0, 0.0, 3.0, 2.0)
    frame = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text")
    out = sharding.assign_shards(frame, weights=weights, added=2.0).collect()
    counts = [sum(r["shard"] == k for r in out) for k in range(4)]
    assert counts[1] == 0 and abs(counts[2] / counts[0] - 3) < 0.4 and abs(counts[3] / counts[0] - 2) < 0.3
    moved = [r for r in out if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 4 for r in moved) and abs(len(moved) / len(out) - 0.25) < 0.03
    assert all(r["shard"] == winner(r["doc_id"], weights) for r in out[:300])
    assert sharding.assign_shards(frame.limit(0)).count() == 0

"""What a Python worker holds at once, and what it gives back."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from noteloom.llm import _shared, _text, near_dedup, quality


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_packer_holds_few_records_at_once():
    def records(k):
        rec = np.zeros(100_000, near_dedup._PAIR)
        rec["v"], rec["doc"] = np.random.default_rng(k).integers(0, 1 << 60, len(rec)), np.arange(len(rec)) + k * len(rec)
        return rec

    seen = np.zeros(14 * 100_000, np.int64)

    def run():
        p = _shared.Packer(96)
        for out in (*(p.add(r["v"], r) for r in map(records, range(14))), p.flush()):
            for batch in out:
                for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                    rec = np.frombuffer(blob.as_buffer(), near_dedup._PAIR)
                    assert (rec["v"] % np.uint64(96) == bucket).all() and (np.diff(rec["doc"]) > 0).all()
                    seen[rec["doc"]] += 1

    assert peak_mb(run) < 70
    assert (seen == 1).all()


@pytest.mark.parametrize("most", [1000, 8 << 20])
def test_packed_batches_hold_every_record(monkeypatch, most):
    monkeypatch.setattr(_shared, "PACKED_BYTES", most)
    rec = np.zeros(5000, near_dedup._LIST)
    rec["v"], rec["doc"] = np.random.default_rng(0).integers(0, 1 << 60, len(rec)), np.arange(len(rec))
    table = pa.Table.from_batches(list(_shared.pack((rec["v"] % np.uint64(24)).astype(np.int32), rec)))
    table.validate(full=True)
    assert len(table) == 24
    got = _shared.unpack(table, near_dedup._LIST)
    assert (got[np.argsort(got["doc"])] == rec).all()


def test_a_block_of_text_takes_few_times_its_size():
    text = pa.array([" ".join(f"word{i * k % 977}" for i in range(400)) for k in range(300)])
    assert peak_mb(lambda: _text.Grid(text)) < 30
    assert peak_mb(lambda: quality.counts(text)) < 60


def test_words_have_the_same_hashes_whatever_the_step(monkeypatch):
    text = pa.array(["a few short words", None, "x" * 5000 + " " + "y " * 3000, "é 日本 words"])
    want, counted = _text.Grid(text).hash, quality.counts(text)
    for step in (64, 1 << 22):
        monkeypatch.setattr(_text, "STEP", step)
        monkeypatch.setattr(quality, "STEP", step)
        assert (_text.Grid(text).hash == want).all() and (quality.counts(text) == counted).all()


def test_small_groups_give_memory_back(monkeypatch):
    times = []
    monkeypatch.setattr(_text, "tidy", lambda: times.append(1))
    monkeypatch.setattr(_text, "_handled", 0)
    for _ in range(10):
        _text.handled(5 << 20)
    assert len(times) == 2

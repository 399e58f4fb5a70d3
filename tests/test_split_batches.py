"""Chunks of a batch come in parts of a bounded size."""

import pyarrow as pa

from rillworks.operators import chunk


def test_a_batch_is_cut_in_parts(monkeypatch):
    monkeypatch.setattr(chunk, "TEXTS", 1000)
    texts = ["word " * 30, None, "", "other words. " * 400, *["some text here. " * 10] * 60]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "x": pa.array(["a"] * len(texts))})
    splitter = chunk.char_splitter(60, 10)
    got = list(chunk.split_batches(iter([batch]), splitter, "text", "chunk"))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(i, "a", no, c) for i, t in enumerate(texts) for no, c in enumerate(splitter(t or ""))]
    assert len(got) > 8 and all(len(set(b["doc_id"].to_pylist())) <= 9 for b in got)

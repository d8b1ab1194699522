"""Batches worked on in slices give what whole batches give."""

import pyarrow as pa

from corpusq.llm import pieces


def test_slices(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 50)
    texts = ["a b c" * k if k % 5 else None for k in range(40)] + ["", "word " * 300, "x", ""]
    b = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    p = pieces.Pieces(open(pieces.MODEL, "rb").read())
    parts = list(pieces.sliced(b, pa.compute.binary_length(b.column(1))))
    assert len(parts) > 10 and pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([b]))
    ids = pa.concat_arrays([pieces.encoded(p, x.column(1)) for x in parts])
    assert ids.to_pylist() == pieces.encoded(p, b.column(1)).to_pylist()
    c = pa.record_batch([ids], names=["ids"])
    back = [t for x in pieces.sliced(c, pa.compute.list_value_length(ids)) for t in pieces.decoded(p, x.column(0)).to_pylist()]
    assert back == [t or "" for t in texts]
    assert not list(pieces.sliced(b.slice(0, 0), pa.array([], pa.int32())))

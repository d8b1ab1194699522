"""Batches are worked on in slices, and come out whole."""

import pyarrow as pa

from corpusq.operators import chunking


class Captured:
    columns = ["doc_id", "text"]

    def mapInArrow(self, run, schema):
        return run

    class _Field:
        class dataType:
            simpleString = staticmethod(lambda: "bigint")

    schema = [_Field]


def test_a_batch_is_handed_on_slice_by_slice():
    texts = ["One sentence of many. " * 20_000, None, "", *["Two of them. " * 10_000] * 40]
    run = chunking.chunk_rows(Captured(), lambda k, t: ((k, i, len(c), x) for c in [chunking.pack(t, 1200, 180, 500)] for i, x in enumerate(c)), "chunk_index int, total_chunks int, chunk_text string")
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = list(run(iter([batch])))
    assert len(out) > 3 and max(b.nbytes for b in out) < 4 << 20
    got = pa.Table.from_batches(out).to_pylist()
    assert [(r["doc_id"], r["chunk_index"], r["total_chunks"], r["chunk_text"]) for r in got] == [(k, i, len(c), x) for k, t in enumerate(texts) for c in [chunking.pack(t, 1200, 180, 500)] for i, x in enumerate(c)]


def test_keys_of_any_kind(spark):
    d = spark.createDataFrame([("a", "One. Two."), (None, "Three.")], "k string, text string")
    assert sorted((r.k or "", r.chunk_text) for r in chunking.pack_chunks(d, "k").collect()) == [("", "Three."), ("a", "One. Two.")]

"""Datasets on disk, chunkers, streams and approximate neighbours."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as functions
from corpusq.operators import chunking, evaluation, vectors
from corpusq.plans import catalog
from corpusq.sources import datasets
from corpusq.sources.snapshots import ChunkTable
from corpusq.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_read_dataset(spark, tmp_path):
    (tmp_path / "train" / "deep").mkdir(parents=True)
    (tmp_path / "train" / "a.csv").write_text("id,text\n1,one\n2,two\n")
    (tmp_path / "train" / "deep" / "b.jsonl").write_text('{"id": 3, "extra": "x"}\n{"id": 4}\n')
    (tmp_path / "train" / "c.json").write_text(json.dumps([{"id": 5, "text": "five"}], indent=1))
    spark.createDataFrame([(6, "six")], "id int, text string").write.parquet(str(tmp_path / "train" / "d"))
    (tmp_path / "train" / "e.txt").write_text("no")
    got = {(r.id, r.text, r.extra, r._source_file.split(".")[-1]) for r in datasets.read_dataset(spark, str(tmp_path)).collect()}
    assert got == {(1, "one", None, "csv"), (2, "two", None, "csv"), (3, None, "x", "jsonl"), (4, None, None, "jsonl"), (5, "five", None, "json"), (6, "six", None, "parquet")}
    assert [r.id for r in datasets.read_dataset(spark, str(tmp_path), row_limit=2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, str(tmp_path / "train" / "e.txt"))


def test_discovery_splits_and_columns(spark, tmp_path):
    d = spark.createDataFrame([(1, " a ", None, "train"), (2, " ", 3, "test")], "id int, Body string, n int, part string")
    counts = datasets.write_splits(d, str(tmp_path / "owner__name"), "part", ["train"])
    assert {(r.split, r.rows) for r in counts.collect()} == {("train", 1), ("test", 1)}
    with pytest.raises(ValueError):
        datasets.write_splits(d, str(tmp_path / "owner__name"), "part", ["validation"])
    read = lambda name: [r.id for r in datasets.read_split(spark, str(tmp_path / "owner__name"), name).collect()]
    assert (read("train"), read("test"), read("validation")) == ([1], [2], [])
    bad = d.withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        datasets.write_splits(bad, str(tmp_path / "owner__name"), "part")
    assert (read("train"), read("test")) == ([1], [2])
    datasets.write_splits(d.where("id = 1"), str(tmp_path / "owner__name"), "part")
    assert (read("train"), read("test")) == ([1], [])
    found = datasets.discover_datasets(spark, str(tmp_path), spark.createDataFrame([("owner/name",)], "dataset_id string")).collect()
    assert [(r.dataset_id, r.formats, r.is_ingested) for r in found] == [("owner/name", "parquet", True)]
    assert [r.combined for r in datasets.combine_columns(d).collect()] == ["Body: a"]
    with pytest.raises(ValueError):
        datasets.combine_columns(d, ["none"])
    datasets.write_chunks(spark.createDataFrame([("d", "f", 7, "t")], "dataset_id string, source_file string, chunk_index int, text string"), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).first().name == "f.chunk-0007"


def test_discovery_against_a_walk(spark, tmp_path):
    (tmp_path / "a__b" / "deep").mkdir(parents=True)
    (tmp_path / "a__b" / "deep" / "test-00000-of-00001.jsonl").write_text('{"id": 1, "text": "x"}\n{"id": 2}\n')
    spark.createDataFrame([(1, "x", [1])], "n int, body string, list array<int>").coalesce(1).write.parquet(str(tmp_path / "a__b" / "split=train"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "bad.parquet").write_bytes(b"none")
    (tmp_path / "c" / "x.csv").write_text('k,"v, w"\n1,2\n3,4\n')
    (tmp_path / "d.json").write_text('[{"p": 1}]')
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.csv").write_text("a\n")
    got = {r.dataset_id: (r.formats, r.splits, r.files, r.rows, r.columns) for r in datasets.discover_datasets(spark, str(tmp_path)).collect()}
    assert got == {"a/b": ("jsonl,parquet", "test,train", 2, 1, "id,text"), "c": ("csv,parquet", "train", 2, None, "k,v, w"), "d": ("json", "train", 1, None, "p")}


def test_chunkers(spark):
    assert chunking.adaptive("a. b\n| x | y |\n| z |", "table_heavy", 1200, 0, 500) == ["a. b", "| x | y |", "| z |"]
    assert chunking.adaptive("text `code` more", "code_mixed", 1200, 0, 500) == ["text", "`code`", "more"]
    assert chunking.adaptive("One. Two. One.", "general", 4, 0, 500) == ["One.", "Two."]
    for t in ["", "  ", "short", "para one. It goes on.\n\npara two is longer than the first one is. Yes.\nline", "x" * 95, "word " * 60]:
        made = chunking.recursive(t, 30, 10)
        assert all(c and len(c) <= 30 for c in made)
        assert set("".join(made).split()) <= set(re.findall(r"\S+", "".join(made))) and "".join(t.split())[:5] == "".join("".join(made).split())[:5]
    d = spark.createDataFrame([(1, "abcdefgh. ijk", "table_heavy", 0), (2, None, "general", 7)], "doc_id int, text string, profile string, own int")
    assert {(r.profile, r.size, r.overlap, r.tokens) for r in functions.chunk_params(d, overlap="own").collect()} == {("table_heavy", 800, 100, 350), ("general", 1200, 7, 500)}


def test_packing_against_a_second_version(spark):
    """Packed chunks of all documents hold all words in order, and each fits or is an overlap with one segment."""
    texts = {r.doc_id: r.text or "" for r in catalog.table(spark, SF, "documents").collect()}
    made = {}
    for r in sorted(catalog.pack_chunks(spark, SF).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        made.setdefault(r.doc_id, []).append(r.chunk_text)
    for i, t in texts.items():
        left = []
        for p in re.split(r"\n\s*\n+", t.strip()):
            left += [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+", p) if s.strip()]
        if any(len(s) > 1200 for s in left):
            continue
        want, held = [], ""
        for s in left:
            joined = f"{held} {s}" if held else s
            if held and (len(joined) > 1200 or max(1, len(joined) // 4) > 500):
                want.append(held)
                tail = held[-180:].strip()
                joined = f"{tail} {s}" if tail else s
            held = joined
        want += [held] if held else []
        assert made.get(i, []) == list(dict.fromkeys(want)), i


def test_stream_that_comes_again(spark, tmp_path):
    """Documents that come again replace their chunks, those that come empty lose them."""
    d = spark.createDataFrame([(1, "One. Two."), (2, "Three."), (5, "Gone soon.")], "doc_id int, text string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    t = ChunkTable(spark, str(tmp_path / "out"), "doc_id", 4)
    run = lambda: ingest.ingest_stream(ingest.arriving(spark, str(tmp_path / "in"), d.schema, 1), t, str(tmp_path / "at")).awaitTermination()
    run()
    spark.createDataFrame([(2, "New. Text."), (3, "x."), (5, "")], d.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {(r.doc_id, r.sentence) for r in t.read().collect()} == {(1, "One."), (1, "Two."), (2, "New."), (2, "Text."), (3, "x.")}
    run()
    assert t.read().count() == 5


def test_flushes_are_bounded(spark, tmp_path):
    texts = ["x" * (k % 90) for k in range(12_345)] + ["y" * 5000, None]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    folder = str(tmp_path)

    def sink(rows):
        import json as j
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            j.dump([(r["id"], r["text"]) for r in rows], f)

    for rows, size in ((5000, 8 << 20), (5000, 1000), (7, 8 << 20)):
        done = ingest.hand_on(d, "text", sink, rows, size).collect()
        flushes = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
        [f.unlink() for f in tmp_path.iterdir()]
        assert sorted(r.rows for r in done) == sorted(map(len, flushes)) and sum(map(len, flushes)) == len(texts)
        assert max(map(len, flushes)) <= rows and all(len(f) == 1 or sum(len(t or "") for _, t in f) <= size for f in flushes)
        assert sorted(i for f in flushes for i, _ in f) == list(range(len(texts)))


def test_scored_ingest(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs.write.parquet(str(tmp_path / "in"))
    t = ChunkTable(spark, str(tmp_path / "out"), "doc_id", 4)
    ingest.ingest_stream(ingest.arriving(spark, str(tmp_path / "in"), docs.schema), t, str(tmp_path / "at"), chunks=ingest.scored_chunks).awaitTermination()
    got = t.read().collect()
    scored = {r.doc_id: r for r in functions.chunk_params(functions.signals(spark.read.parquet(str(tmp_path / "in")))).collect()}
    for r in got:
        of = scored[r.doc_id]
        made = chunking.adaptive(of.text, of.profile, of.size, of.overlap, of.tokens)
        assert made[r.chunk_index] == r.chunk_text and r.total_chunks == len(made) and r.quality_score == of.quality_score
        assert abs(sum(x * x for x in r.dense) - 1) < 1e-9 and sum(r["values"]) == len(re.findall(r"[^\W_]+", r.chunk_text.lower()))
    assert {r.doc_id for r in got} == {i for i, r in scored.items() if (r.text or "").strip()}


def test_corrupt_files_are_skipped_whole(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "good.jsonl").write_text('{"id": 1, "text": "a"}\n{"id": 2, "text": null}\n')
    (tmp_path / "train" / "half.jsonl").write_text('{"id": 3, "text": "b"}\n{"id": 4, "te\n')
    (tmp_path / "train" / "bad.json").write_text("no json at all")
    (tmp_path / "train" / "bad.parquet").write_bytes(b"no parquet")
    d = datasets.read_dataset(spark, str(tmp_path))
    assert set(d.columns) == {"id", "text", "_source_file"} and sorted((r.id, r.text) for r in d.collect()) == [(1, "a"), (2, None)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "bad.json").write_text("no json")
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, str(tmp_path / "none"))


def test_quota_against_a_loop(spark):
    import random

    rnd = random.Random(2)
    files = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, 0, 3, 20, 55, 200]), "x") for i in range(400)] + [(1000, "c", 50, "x"), (1001, "c", 20, "x"), (1002, "c", 5, "x")]
    held = {"a": 30, None: 10}
    want, now = {}, dict(held)
    for i, of, n, _ in files:
        ok = (n or 0) <= 100 and now.get(of, 0) + (n or 0) <= (60 if of == "c" else 60)
        now[of] = now.get(of, 0) + (n or 0) * ok
        want[i] = ok
    d = spark.createDataFrame(files, "id int, dataset string, bytes long, _held string").repartition(5)
    got = datasets.admit_by_quota(d, "dataset", "bytes", "id", 100, 60, existing=spark.createDataFrame(list(held.items()), "dataset string, total long"))
    assert got.columns == [*d.columns, "admitted"] and {r.id: r.admitted for r in got.collect()} == want
    assert [want[i] for i in (1000, 1001, 1002)] == [True, False, True]


def test_code_segments_of_texts_with_marks(spark):
    d = spark.createDataFrame([(1, "a\x01b `x\x02` c"), (2, "```p\nq```"), (3, None), (4, " ")], "doc_id int, text string")
    assert sorted(map(tuple, chunking.split_code(d).collect())) == [(1, 0, False, "a\x01b"), (1, 1, True, "`x\x02`"), (1, 2, False, "c"), (2, 0, True, "```p\nq```")]


def test_dedup_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:00:00")], "key string, at string").select("key", F.to_timestamp("at").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.dedup_stream(ingest.arriving(spark, str(tmp_path / "in"), rows.schema), "key", "at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_embedder(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.vector for r in vectors.embed_dense(d, "doc_id", "text").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[3])
    with pytest.raises(Exception, match="0 vectors"):
        vectors.embed_dense(d, "doc_id", "text", lambda t: []).collect()


def test_tokens_with_errors(spark):
    rows = [(1, 0, '{"type": "chunk", "content": "a"}'), (1, 1, ""), (1, 2, "no json"), (1, 3, '{"type": "chunk", "content": "b"}'), (1, 4, '{"type": "end", "sources": "s"}'), (2, 0, '{"type": "error", "error": "e"}')]
    got = {r.id: (r.text, r.sources, r.error) for r in evaluation.assemble_tokens(spark.createDataFrame(rows, "id int, k int, line string"), "id", "k", "line").collect()}
    assert got == {1: ("ab", "s", None), 2: ("", None, "e")}

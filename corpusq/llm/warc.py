"""WARC archives with a two-level capture index: write, index, look up, read by range."""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

CRLF = b"\r\n"
#: An empty gzip member. Spark's text writer puts it after each record, so every record is a member of its own.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
GZIP = 16 + zlib.MAX_WBITS
LINES_PER_BLOCK = 256
#: Bytes of an archive whose ranges one group reads; bytes between ranges that are read along rather than skipped.
STRIPE, GAP = 8 << 20, 1 << 16


def escaped(url: Column) -> Column:
    """The URL as archives hold it: characters below a space as % and their code."""
    text = url.cast("string")
    out = text
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return F.when(text.rlike(r"[\x00-\x1f]"), out).otherwise(text)


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels in reverse, then port, path and query; lower case, without scheme,
    fragment, user and leading www. Null and hostless URLs give their own text after a "-"."""
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""))
    part = lambda i: F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?(?:www\d*\.)?([^/:?]+)(?::(\d+))?(.*)$", i)
    host = F.array_join(F.reverse(F.split(part(1), r"\.")), ",")
    port = F.when(part(2) != "", F.concat(F.lit(":"), part(2))).otherwise("")
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(part(1) == "", F.concat(F.lit("-"), u)).otherwise(F.concat(host, port, F.lit(")"), path))


def duplicates(pages: DataFrame, page_id: str, html: str, least: int) -> DataFrame:
    """(id, digest, response's id) of pages whose payload, of `least` bytes or more, an earlier id has as well."""
    p = pages.select(F.col(page_id).alias("_id"), F.sha2(F.coalesce(F.col(html), F.lit("")), 256).alias("_digest"), F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("_bytes"))
    p = p.where((F.col("_bytes") >= least) & F.col("_id").isNotNull()).select("_id", "_digest")
    first = p.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where(F.col("_first") < F.col("_last")).drop("_last")
    return p.join(first, "_digest").where(F.col("_id") > F.col("_first")).select("_id", "_digest", "_first").distinct()


def record_name(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, html: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member; the URL is escaped."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {url}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {page_id}"] if page_id is not None else []
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + CRLF + CRLF
    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, records_per_file: int = 20_000) -> None:
    """Write one record per row into .gz archives of at most `records_per_file` records under `path`.

    Only (id, digest) pairs are shuffled to find equal payloads; the pages stay where they are read unless the
    list of revisits is too large to broadcast.
    """
    copies = written(duplicates(pages, page_id, html, least), "revisits")
    own = pages.select(F.col(page_id).alias("_page"), escaped(F.col(url)).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"), F.sha2(F.coalesce(F.col(html), F.lit("")), 256).alias("_sha"))
    own = own.join(copies, (F.col("_page") == F.col("_id")) & (F.col("_sha") == F.col("_digest")), "left").select("_page", "_url", "_html", "_sha", "_first")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [record(i, u, h.encode(), d, r) for i, u, h, d, r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch({"member": pa.array(out, pa.binary())})

    made = own.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)


def parse(raw: bytes) -> dict:
    """The headers of a record, with the length and digest of its payload where it has one."""
    head, _, block = raw.partition(CRLF + CRLF)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    fields["http_length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return fields | {"payload": payload}


def members_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, plain bytes) of the members of a gzip file that hold anything."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, start, parts = zlib.decompressobj(GZIP), at, []
        while not z.eof and at < len(view):
            piece = view[at : at + 65536]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if plain := b"".join(parts):
            yield start, at - start, plain


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: where it stands and what its headers say; a file at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(file, at, n, f.get("X-Page"), f.get("WARC-Target-URI"), f["WARC-Type"]) for at, n, raw in members_of(data.as_buffer().to_pybytes()) for f in [parse(raw)]]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["file", "at", "n", "page", "uri", "type"]).astype({"at": "int64", "n": "int64"}), schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("page", pa.string()), ("uri", pa.string()), ("type", pa.string())]), preserve_index=False)

    return archive_files(spark, path).select("path", "content").mapInArrow(scan, "file string, at long, n long, page string, uri string, type string")


def write_index(caps: DataFrame, path: str, lines: int = LINES_PER_BLOCK) -> None:
    """The two-level index: captures sorted by URL key and page, in compressed blocks of `lines` lines
    (`path`/blocks), and a directory with the first key of each block (`path`/directory), one row a partition."""
    spark = caps.sparkSession
    keyed = caps.select(F.concat_ws(" ", url_key(F.col("uri")), F.coalesce(F.lpad("page", 20, "0"), F.lit("-"))).alias("key"), "file", "at", "n")
    ordered = keyed.repartitionByRange("key", "file", "at").sortWithinPartitions("key", "file", "at").withColumn("part", F.spark_partition_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, first, last = None, 0, [], None, None

        def made() -> pa.RecordBatch:
            return pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "first": pa.array([first]), "last": pa.array([last]), "lines": pa.array([zlib.compress("\n".join(held).encode())], pa.binary())})

        for b in batches:
            for key, file, at, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) == lines:
                    yield made()
                    held, number = [], number + 1
                first = key if not held else first
                part, last = p, key
                held.append(f"{key}\t{file}\t{at}\t{n}")
        if held:
            yield made()

    ordered.mapInArrow(blocks, "part int, block int, first string, last string, lines binary").write.parquet(f"{path}/blocks")
    b = spark.read.parquet(f"{path}/blocks")
    listed = F.array_sort(F.collect_list(F.struct("block", "first")))
    b.groupBy("part").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.transform(listed, lambda x: x.first).alias("firsts")).write.parquet(f"{path}/directory")


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """key -> key, file, at, n of every capture with that key: binary search in the directory, then in the block.

    The driver holds the lowest key of each partition, a number set by the partitions of the sort. Wanted keys
    meet their partition's directory and then their block in joins; keys that span blocks look in each.
    """
    lows = sorted((r.low, r.part) for r in spark.read.parquet(f"{path}/directory").select("low", "part").toLocalIterator())
    keys, parts = [x[0] for x in lows], [x[1] for x in lows]

    def find_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, parts[i]) for k in b.column(0).to_pylist() if k is not None for i in range(max(0, bisect.bisect_left(keys, k) - 1), bisect.bisect_right(keys, k))]
            yield pa.record_batch({"key": pa.array([x[0] for x in rows], pa.string()), "part": pa.array([x[1] for x in rows], pa.int32())})

    def find_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, p, firsts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows += [(k, p, i) for i in range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k))]
            yield pa.record_batch({"key": pa.array([x[0] for x in rows], pa.string()), "part": pa.array([x[1] for x in rows], pa.int32()), "block": pa.array([x[2] for x in rows], pa.int32())})

    def in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, lines, line_keys = None, [], []
        for b in batches:
            rows = []
            for k, where, packed in zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), b.column(3), strict=True):
                if where != seen:
                    seen, lines = where, [x.split("\t") for x in zlib.decompress(packed.as_py()).decode().split("\n")]
                    line_keys = [x[0] for x in lines]
                rows += [(k, x[1], int(x[2]), int(x[3])) for x in lines[bisect.bisect_left(line_keys, k) : bisect.bisect_right(line_keys, k)]]
            yield pa.record_batch({"key": pa.array([x[0] for x in rows], pa.string()), "file": pa.array([x[1] for x in rows], pa.string()), "at": pa.array([x[2] for x in rows], pa.int64()), "n": pa.array([x[3] for x in rows], pa.int64())})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at_part = wanted.select("key").repartition(tasks, "key").distinct().mapInArrow(find_part, "key string, part int")
    at_block = at_part.join(spark.read.parquet(f"{path}/directory").select("part", "firsts"), "part").select("key", "part", "firsts").mapInArrow(find_block, "key string, part int, block int")
    with_lines = at_block.join(spark.read.parquet(f"{path}/blocks").select("part", "block", "lines"), ["part", "block"]).select("key", "part", "block", "lines")
    return with_lines.sortWithinPartitions("part", "block").mapInArrow(in_block, "key string, file string, at long, n long")


def opened(uri: str):
    """A file of the shared folder, for reads at an offset."""
    where, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return where.open_input_file(path)


def runs_of(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges) of sorted ranges that lie close together, STRIPE bytes at most unless one range is longer."""
    held: list[tuple[int, int]] = []
    for at, n in ranges:
        if held and (at - sum(held[-1]) > GAP or at + n - held[0][0] > STRIPE):
            yield held[0][0], sum(held[-1]), held
            held = []
        held.append((at, n))
    if held:
        yield held[0][0], sum(held[-1]), held


def read_ranges(ranges: DataFrame) -> DataFrame:
    """file, at, n -> the records that stand there, with what their headers and payloads say.

    Ranges meet by file and stripe of STRIPE bytes, are put in order, and are read from the shared folder by offset;
    what lies near together is read at once, what lies between is not read."""
    kind = "page string, uri string, type string, refers string, digest string, http_length long, payload binary"
    schema = pa.schema([(c, pa.string()) for c in ("page", "uri", "type", "refers", "digest")] + [("http_length", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, places = b.column(0).to_pylist(), list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            rows, held = [], 0
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                with opened(files[x]) as f:
                    for start, end, own in runs_of(sorted(places[x:y])):
                        view = memoryview(f.read_at(end - start, start))
                        for at, n in own:
                            r = parse(zlib.decompress(view[at - start : at - start + n], GZIP))
                            rows.append((r.get("X-Page"), r.get("WARC-Target-URI"), r["WARC-Type"], r.get("X-Refers-To-Page"), r["WARC-Payload-Digest"].removeprefix("sha256:"), int(r["http_length"]), r["payload"]))
                            held += len(r["payload"])
                            if held > 8 << 20:
                                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                                rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    striped = ranges.select("file", F.floor(F.col("at") / STRIPE).alias("stripe"), "at", "n").repartition(tasks, "file", "stripe")
    return striped.sortWithinPartitions("file", "stripe", "at").mapInArrow(read, kind)


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Write the pages, index the archives, look every page up and read it back by its range.

    Of equal payloads of `least` bytes or more the smallest page_id is the response and the others revisit it.
    Payload digests of responses are taken anew from the bytes read. Null html is an empty payload; null URLs have
    keys of their own; a null page_id is a response of its own. Rows that share a page_id are each a record, and only
    those whose own payload an earlier id has are revisits. Rows equal in all are records alike. Very long payloads
    are one record. Other columns, whatever their names, are not read. Empty table: empty archives, empty result.
    """
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_archives(pages, f"{path}/archives", page_id, url, html, least)
    caps = written(captures(spark, f"{path}/archives"), "captures")
    write_index(caps, f"{path}/index")
    wanted = pages.select(F.concat_ws(" ", url_key(escaped(F.col(url))), F.coalesce(F.lpad(F.col(page_id).cast("string"), 20, "0"), F.lit("-"))).alias("key"))
    found = read_ranges(lookup(spark, f"{path}/index", wanted).select("file", "at", "n").distinct())
    kind = pages.schema[page_id].dataType
    digest = F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return found.select(
        F.col("page").cast(kind).alias(page_id), F.col("uri").alias(url), F.col("http_length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to")
    )

"""Datasets on disk and as chunk tables: reading, columns into text, listing, quotas, splits, rewriting."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructField, StructType

from corpusq.sources.snapshots import Snapshots

#: File formats, and the columns that hold text, in order of preference.
FORMATS = ("parquet", "json", "jsonl", "csv")
TEXT_COLUMNS = ("text", "content", "document", "passage", "body", "article", "context", "story", "summary", "description", "review", "sentence", "query", "input", "output")
#: Bytes that a file and a dataset may have.
MAX_FILE, MAX_DATASET = 500 << 20, 100 << 30


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, ext) of all files below a path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    return f.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def without_corrupt_files(d: DataFrame, bad: str = "_corrupt_record") -> DataFrame | None:
    """Rows of JSON files all of whose lines can be read; None where no file has any. `d` is as read, with `_metadata`."""
    if bad not in d.columns:
        return d
    good = [c for c in d.columns if c not in (bad, "_source_file", "_metadata")]
    if not good:
        return None
    file = F.col("_metadata.file_path")
    # a bad line is only seen if more columns than its own are read
    others = F.sum(sum((F.col(f"`{c}`").isNotNull().cast("int") for c in good), F.lit(0)))
    corrupt = d.withColumn("_file", file).groupBy("_file").agg(F.max(F.col(bad).isNotNull()).alias("_bad"), others.alias("_others")).where("_bad and _others >= 0").select("_file")
    return d.withColumn("_file", file).join(corrupt, "_file", "left_anti").drop("_file", bad)


def read_dataset(spark: SparkSession, path: str, split: str = "train", row_limit: int | None = None) -> DataFrame:
    """All files of the known formats below `path`/`split`, or `path` if there is no such folder, united by column name
    with `_source_file`. Files that cannot be read, and JSON files with a line that cannot, are skipped whole; nothing
    readable is an error. With a limit, the first rows in order of file name and place."""
    try:
        at = f"{path}/{split}"
        found = {r.ext for r in listing(spark, at).select("ext").distinct().collect()}
    except AnalysisException:
        at = path
        found = {r.ext for r in listing(spark, at).select("ext").distinct().collect()}
    frames = []
    for ext in FORMATS:
        if ext in found:
            reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ext}").option("ignoreCorruptFiles", "true")
            reader = reader.format("json").option("multiLine", ext == "json") if ext in ("json", "jsonl") else reader.format(ext)
            reader = reader.option("header", "true").option("inferSchema", "true") if ext == "csv" else reader
            try:
                d = reader.load(at)
            except AnalysisException:  # no file of this format tells its columns
                continue
            d = d.select(*[F.col(f"`{c}`") for c in d.columns], F.col("_metadata.file_name").alias("_source_file"), "_metadata")
            if (readable := without_corrupt_files(d)) is not None:
                frames.append(readable.drop("_metadata"))
    if not frames:
        raise ValueError(f"no readable files in {path}")
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return limit_rows(out.withColumn("_place", F.monotonically_increasing_id()), row_limit, "_source_file", "_place").drop("_place") if row_limit else out


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order given: each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def text_columns(df: DataFrame) -> list[str]:
    """The column that most likely holds text: by preference, else the first text column."""
    named = {c.strip().lower(): c for c in reversed(df.columns)}
    text = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name != "_source_file"]
    best = next((named[c] for c in TEXT_COLUMNS if c in named), None) or (text[0] if text else None)
    if best is None:
        raise ValueError("no text column")
    return [best]


def combine_columns(df: DataFrame, columns: list[str] | None = None, to: str = "combined") -> DataFrame:
    """"Name: value" lines of the columns that hold something; rows with nothing go. Missing columns are an error."""
    if missing := [c for c in columns or () if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    kinds = {f.name: f.dataType for f in df.schema}
    lines = []
    for c in columns or text_columns(df):
        label, x = c.replace("_", " ").title() + ": ", F.col(f"`{c}`")
        if isinstance(kinds[c], StringType):
            lines.append(F.when(F.trim(x) != "", F.concat(F.lit(label), F.trim(x))))
        elif isinstance(kinds[c], (NumericType, BooleanType)):
            lines.append(F.concat(F.lit(label), x.cast("string")))
    return df.withColumn(to, F.concat_ws("\n", *lines)).where(F.col(to) != "")


def project_metadata(df: DataFrame, text: list[str], wanted: list[str] | None = None) -> DataFrame:
    """Adds `metadata`, a map of the scalar columns that are not text (those wanted) without nulls; the file is `unknown`
    where it is not known."""
    simple = [f.name for f in df.schema if isinstance(f.dataType, (StringType, NumericType, BooleanType)) and f.name not in (*text, "_source_file")]
    pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in simple if wanted is None or c in wanted]
    file = F.coalesce(F.col("_source_file"), F.lit("unknown")) if "_source_file" in df.columns else F.lit("unknown")
    entries = F.filter(F.array(*pairs, F.struct(F.lit("_source_file").alias("key"), file.alias("value"))), lambda e: e.value.isNotNull())
    return df.withColumn("metadata", F.map_from_entries(entries))


#: Splits that names of files and folders tell.
SPLITS = ("train", "test", "validation", "dev")
#: Bytes of a text file that are read to tell its columns.
HEAD = 1 << 16


def columns_of(file, ext: str) -> tuple[int | None, list[str]]:
    """(rows where the file tells them, names of the columns that hold numbers, booleans or text) of an open file."""
    if ext == "parquet":
        f = pq.ParquetFile(file)
        simple = lambda t: pa.types.is_primitive(t) and not pa.types.is_temporal(t) or pa.types.is_string(t) or pa.types.is_large_string(t)
        return f.metadata.num_rows, [c.name for c in f.schema_arrow if simple(c.type)]
    head = file.read(HEAD).decode("utf-8", "replace")
    if ext == "csv":
        return None, next(csv.reader([head.split("\n", 1)[0].rstrip("\r")]), [])
    text = head.lstrip()
    first = json.JSONDecoder().raw_decode(text[1:].lstrip() if text.startswith("[") else text)[0]
    return None, list(first) if isinstance(first, dict) else []


def file_facts(files: DataFrame) -> DataFrame:
    """(path, ext) -> path, readable, rows and columns. Tasks read the footer of a parquet file, and the beginning of
    others; rows are known of parquet alone. Files of a scheme that Arrow does not serve are not readable here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, ext in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    where, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    with where.open_input_file(at) as f:
                        out.append((path, True, *columns_of(f, ext)))
                except (OSError, ValueError, pa.ArrowException):
                    out.append((path, False, None, []))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string())))] if out else [pa.array([], t) for t in (pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()))], names=["path", "readable", "rows", "columns"])

    return files.select("path", "ext").mapInArrow(run, "path string, readable boolean, rows long, columns array<string>")


def discover_datasets(spark: SparkSession, root: str, ingested: DataFrame | None = None) -> DataFrame:
    """One row per folder or file right below `root`: id, formats, splits, files, bytes, rows and columns of what can be read,
    and whether it is ingested (`dataset_id` in a table).

    Names that begin with _ or . are left out; __ in a name stands for /. A split is told by a part between dashes, dots
    or "=" of a file's or folder's name; without one it is train. Rows are summed over parquet files, null without any;
    columns are those of the readable file of the smallest path. Only footers and first lines are read, in tasks.
    """
    f = listing(spark, root).withColumn("_name", F.regexp_extract("path", r"[^/]*/*" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + r"/+([^/]+)", 1))
    f = f.where(~F.col("_name").rlike(r"^[_.]") & (F.col("_name") != "") & F.col("ext").isin(*FORMATS))
    inner = F.substring_index("path", "/", -1)
    below = F.concat_ws("/", F.regexp_extract("path", "/([^/]+)/[^/]+$", 1), inner)
    told = F.array_intersect(F.split(below, r"[-./=]"), F.array(*map(F.lit, SPLITS)))
    name = F.replace(F.regexp_replace("_name", r"\.[^.]+$", ""), F.lit("__"), F.lit("/"))
    # a task for some hundred files, however large they are
    d = f.select("path", "bytes", "ext", told.alias("_told"), name.alias("dataset_id"))
    facts = file_facts(d.repartition(F.pmod(F.xxhash64("path"), F.lit(1024))))
    d = d.join(facts, "path").groupBy("dataset_id").agg(
        F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("formats"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_told")))), ",").alias("_splits"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
        F.sum("rows").alias("rows"), F.array_join(F.min_by(F.when(F.col("readable"), F.col("columns")), F.when(F.col("readable"), F.col("path"))), ",").alias("columns"),
    )
    d = d.withColumn("splits", F.when(F.col("_splits") == "", "train").otherwise(F.col("_splits"))).drop("_splits")
    if ingested is None:
        return d.withColumn("is_ingested", F.lit(False)).orderBy("dataset_id")
    known = ingested.select("dataset_id").distinct().withColumn("_known", F.lit(True))
    return d.join(known, "dataset_id", "left").withColumn("is_ingested", F.coalesce("_known", F.lit(False))).drop("_known").orderBy("dataset_id")


def filter_supported(files: DataFrame, path: str, extensions: tuple[str, ...]) -> DataFrame:
    return files.where(F.lower(F.regexp_extract(path, r"\.([^./?#]+)$", 1)).isin(*extensions))


def admit_by_quota(files: DataFrame, dataset: str, size: str, arrival: str, max_file: int = MAX_FILE, max_total: int = MAX_DATASET, existing: DataFrame | None = None) -> DataFrame:
    """Adds `admitted`: whether a file has at most `max_file` bytes and, with those that its dataset holds by then, at most
    `max_total`. A file that is not admitted takes no room. `existing` (dataset, total) are bytes held before.

    Files come in order of arrival (of equal ones the smaller first), which one task follows for each dataset, row by row:
    what it holds is one number. Null sizes count as 0.
    """
    total = free_name(files, "_held")
    held = existing.select(F.col(dataset).alias("_of"), F.col("total").cast("long").alias(total)) if existing is not None else None
    d = files.join(held, F.col(dataset).eqNullSafe(F.col("_of")), "left").drop("_of") if held is not None else files.withColumn(total, F.lit(0).cast("long"))
    columns = files.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sum_ = object(), 0
        for b in batches:
            admitted = []
            for of, n, before in zip(*(b.column(c).to_pylist() for c in (dataset, size, total)), strict=True):
                if of != now:
                    now, sum_ = of, before or 0
                n = n or 0
                admitted.append(n <= max_file and sum_ + n <= max_total)
                sum_ += n if admitted[-1] else 0
            yield pa.record_batch([b.column(c) for c in columns] + [pa.array(admitted, pa.bool_())], names=[*columns, "admitted"])

    kinds = StructType([*files.schema.fields, StructField("admitted", BooleanType())])
    return d.repartition(dataset).sortWithinPartitions(dataset, arrival, size).mapInArrow(fold, kinds)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it one that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def chunk_names(chunks: DataFrame, stem: str, index: str) -> DataFrame:
    return chunks.withColumn("name", F.format_string("%s.chunk-%04d", F.col(stem), F.col(index)))


def write_chunks(chunks: DataFrame, path: str, dataset: str = "dataset_id", stem: str = "source_file", index: str = "chunk_index") -> None:
    """Chunks with names of their own, in one folder per dataset."""
    chunk_names(chunks, stem, index).write.mode("append").partitionBy(dataset).parquet(path)


def delete_datasets(chunks: DataFrame, ids: DataFrame, dataset: str) -> DataFrame:
    """The chunks of all other datasets, those of none among them."""
    return chunks.join(ids.select(dataset).distinct(), dataset, "left_anti")


def list_datasets(info: DataFrame, dataset: str, skip: int, limit: int) -> DataFrame:
    """A page of the datasets in order of name, each row with how many there are in all."""
    total = info.where(F.col(dataset).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    page = info.where(F.col(dataset).isNotNull()).orderBy(dataset).offset(skip).limit(limit)
    return page.join(F.broadcast(total))  # one row


def indexed(rows: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Adds `indexed`: whether the key has points."""
    has = points.select(key).distinct().withColumn("_has", F.lit(True))
    return rows.join(has, key, "left").withColumn("indexed", F.coalesce("_has", F.lit(False))).drop("_has")


def assemble_sheets(cells: DataFrame, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of each sheet -> its text: a heading and one line per row, nulls as empty."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    d = cells.groupBy(sheet).agg(F.transform(lines, lambda x: x.line).alias("_lines"))
    return d.select(sheet, F.array_join(F.concat(F.array(F.concat(F.lit("[Sheet: "), F.col(sheet).cast("string"), F.lit("]"))), F.col("_lines")), "\n").alias("text"))


def assemble_paragraphs(paragraphs: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """The paragraphs of each document that are not blank, in order, as one text."""
    kept = paragraphs.where(F.trim(F.regexp_replace(text, r"\s", " ")) != "")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return kept.groupBy(document).agg(F.regexp_replace(F.array_join(F.transform(parts, lambda x: x.t), "\n"), r"^\s+|\s+$", "").alias("text"))


def split_of(key: str, shares: tuple[tuple[str, int], ...] = (("train", 8), ("validation", 1), ("test", 1))) -> Column:
    """A split by the key's remainder, with the shares given."""
    place = F.pmod(F.col(key), F.lit(sum(n for _, n in shares)))
    out, upto = F, 0
    for name, n in shares:
        upto += n
        out = out.when(place < upto, name)
    return out


def write_splits(df: DataFrame, path: str, split: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """One folder per split (`train` if there is no such column); (split, rows) of what was written. Splits that are not
    null take the place of all that stood at `path`, as one version: a write that fails leaves what was there. A wanted
    split that is not there is an error."""
    d = df.withColumn("split", F.col(split) if split else F.lit("train"))
    counts = d.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    if missing := set(wanted or ()) - {r.split for r in counts.select("split").collect()}:
        raise ValueError(f"no such splits: {sorted(missing)}")
    target = Snapshots(df.sparkSession, path, "split")
    target.put(d, {}, target.version() + 1)
    return counts


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The rows of a split in the latest version of what `write_splits` has written."""
    return Snapshots(spark, path, "split").parts(wanted={split})

"""Queries over datasets, layouts, characters and chunks, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import shared
from corpusq.functions import characters, text
from corpusq.functions import tables as functions
from corpusq.operators import chunking, evaluation, layout
from corpusq.sources import datasets
from corpusq.sources.snapshots import ChunkTable


def table(spark, sf_dir, name):
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return shared.spread(d) if name in ("documents", "pages") else d  # their texts are worth a task each core


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def blocks(spark, sf_dir):
    """The lines of documents as layout blocks: two columns, thirty rows a page, sizes by length."""
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "text"))
    row = F.floor(F.col("k") / 2) % 30
    y0 = row * 26.0 + 5
    x0 = 30.0 + 280 * (F.col("k") % 2)
    sizes = {"page": F.floor(F.col("k") / 60), "x0": x0, "y0": y0, "x1": x0 + 250, "y1": y0 + 20, "font": 9.0 + (F.length("text") * 7) % 12, "page_width": F.lit(600.0), "page_height": F.lit(800.0)}
    return layout.reading_order(layout.classify_blocks(d.withColumns(sizes)))


def read_dataset(spark, sf_dir):
    return datasets.read_dataset(spark, f"{sf_dir}/labels.parquet").drop("_source_file")


def limit_rows(spark, sf_dir):
    """The first hundred documents: the operator's purpose."""
    return datasets.limit_rows(documents(spark, sf_dir).select("doc_id", "source"), 100, "doc_id")


def combine_columns(spark, sf_dir):
    return datasets.combine_columns(documents(spark, sf_dir), ["source", "lang", "text", "n_chars"]).select("doc_id", "combined")


def project_metadata(spark, sf_dir):
    d = datasets.project_metadata(documents(spark, sf_dir), ["text"])
    return d.select("doc_id", *[F.col("metadata")[c].alias(c) for c in ("source", "lang", "n_chars", "_source_file")])


def discover_datasets(spark, sf_dir):
    return datasets.discover_datasets(spark, sf_dir)


def discovered_rows(spark, sf_dir):
    """The rows that the files of the text tables tell, against those of the tables."""
    found = datasets.discover_datasets(spark, sf_dir).where(F.col("dataset_id").isin("documents", "benchmark", "labels", "pages")).select("dataset_id", "rows", "columns")
    counts = None
    for name in ("documents", "benchmark", "labels", "pages"):
        n = table(spark, sf_dir, name).agg(F.lit(name).alias("dataset_id"), F.count(F.lit(1)).alias("counted"))
        counts = n if counts is None else counts.unionByName(n)
    return found.join(counts, "dataset_id")


def files(spark, sf_dir):
    """Documents as incoming files of their source."""
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "TXT", "exe", "csv"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.col("source").alias("dataset"), F.concat_ws(".", F.concat(F.lit("doc"), F.col("doc_id")), ext).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def filter_supported(spark, sf_dir):
    return datasets.filter_supported(files(spark, sf_dir), "path", ("pdf", "txt", "csv")).select("doc_id", "path")


def admit_by_quota(spark, sf_dir):
    return datasets.admit_by_quota(files(spark, sf_dir), "dataset", "bytes", "doc_id", 20_000, 60_000).select("doc_id", "admitted")


def write_chunks(spark, sf_dir):
    """Sentences written under names of their own, a folder for each source, and read back."""
    at = shared.new_path(spark, "named-chunks")
    c = chunking.sentences(documents(spark, sf_dir)).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    datasets.write_chunks(c, at, "source", "doc_id", "sentence_index")
    return spark.read.parquet(at).select("doc_id", "sentence_index", "name")


def write_splits(spark, sf_dir):
    """Documents written in splits, and the rows of each read back."""
    at = shared.new_path(spark, "splits")
    datasets.write_splits(documents(spark, sf_dir).withColumn("part", datasets.split_of("doc_id")), at, "part")
    rows = [datasets.read_split(spark, at, name).agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("rows")) for name in ("train", "validation", "test")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def delete_dataset(spark, sf_dir):
    """A table of the documents after those of the first source are taken away."""
    t = ChunkTable(spark, shared.new_path(spark, "chunks"), "doc_id")
    d = documents(spark, sf_dir).select("doc_id", "source")
    t.merge(d)
    t.delete(d.join(d.agg(F.min("source").alias("source")), "source"), 1)
    return t.read()


def list_datasets(spark, sf_dir):
    info = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("points"))
    return datasets.list_datasets(info, "source", 2, 5)


def has_points(spark, sf_dir):
    return datasets.indexed(documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "indexed")


def assemble_sheets(spark, sf_dir):
    return datasets.assemble_sheets(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["turn", "role", "text"])


def assemble_paragraphs(spark, sf_dir):
    return datasets.assemble_paragraphs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def char_classes(spark, sf_dir):
    return characters.char_classes(documents(spark, sf_dir), "text").select("doc_id", *characters.NAMES)


def analyze_text(spark, sf_dir):
    d = characters.analyze_text(documents(spark, sf_dir), "text")
    return d.select("doc_id", "characters", "alpha_ratio", F.array_join(F.array_sort(F.map_keys("types")), ",").alias("types"))


def analyze_chunks(spark, sf_dir):
    d = characters.analyze_text(chunking.paragraphs(documents(spark, sf_dir)), "paragraph")
    return d.select("doc_id", "paragraph_index", "characters", "alpha_ratio")


def resolve_chunk_params(spark, sf_dir):
    """Presets of each document's profile; every third document brings its own overlap, 0 among them."""
    d = text.signals(documents(spark, sf_dir)).withColumn("own", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 * 10))
    return text.chunk_params(d, overlap="own").select("doc_id", "profile", "size", "overlap", "tokens")


def noise_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).where(layout.is_noise(F.col("text"))).select("doc_id", "page", "place")


def classify_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "page", "place", "kind")


def layout_to_text(spark, sf_dir):
    return layout.layout_to_text(blocks(spark, sf_dir))


def layout_summary(spark, sf_dir):
    d = layout.layout_summary(blocks(spark, sf_dir))
    return d.select("doc_id", "pages", "blocks", F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat_ws(":", e.key, e.value)), ",").alias("kinds"))


def vertical_overlap(spark, sf_dir):
    return layout.vertical_overlap(blocks(spark, sf_dir))


def spaced(spark, sf_dir, old, new):
    """Documents with the marks put in that the splitters look for."""
    return documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit(old), F.lit(new)))


def split_paragraphs(spark, sf_dir):
    return chunking.paragraphs(spaced(spark, sf_dir, ". ", ".\n \n"))


def split_tables(spark, sf_dir):
    return chunking.split_tables(spaced(spark, sf_dir, ". ", ".\n| "))


def split_code(spark, sf_dir):
    return chunking.split_code(spaced(spark, sf_dir, ", ", ", `x = 1` "))


def adaptive_chunk(spark, sf_dir):
    return chunking.adaptive_chunks(text.chunk_params(text.signals(documents(spark, sf_dir))))


def recursive_chunk(spark, sf_dir):
    return chunking.recursive_chunks(documents(spark, sf_dir))


def dedupe_chunks(spark, sf_dir):
    return chunking.dedupe_chunks(chunking.sentences(documents(spark, sf_dir)), "doc_id", "sentence_index", "sentence")


def chunk_metadata(spark, sf_dir):
    """Each chunk's place, its document's quality, profile, split and source, and the models of its vectors."""
    d = text.signals(documents(spark, sf_dir)).withColumn("split", datasets.split_of("doc_id"))
    c = chunking.sentences(documents(spark, sf_dir)).drop("sentence")
    return chunking.chunk_metadata(c, d, "doc_id", ["source", "lang", "split", "quality_score", "profile"], {"embedding_model": "hashed-words-64", "sparse_model": "word-counts"})


def pack_chunks_sql(spark, sf_dir):
    """Packed chunks by the table function, in SQL."""
    functions.register(spark, "corpusq_")
    documents(spark, sf_dir).createOrReplaceTempView("corpusq_documents")
    return spark.sql("SELECT d.doc_id, c.* FROM corpusq_documents d, LATERAL corpusq_pack_chunks(d.text, 1200, 180, 500) c")


def chunk_size_stats(spark, sf_dir):
    n = chunking.sentences(documents(spark, sf_dir)).select(F.lit("all").alias("of"), F.length("sentence").alias("n_chars"))
    ends = n.groupBy("of").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), text.rounded(F.avg("n_chars"), 4).alias("mean"))
    return evaluation.latency_percentiles(n, "of", "n_chars").join(ends, "of")


def scored(spark, sf_dir):
    d = text.signals(documents(spark, sf_dir)).select("doc_id", "source", "profile", "quality_score", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    c = chunking.sentences(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return d.join(c, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def ingest_summary(spark, sf_dir):
    by = scored(spark, sf_dir).groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.sum("chunks").alias("c"), F.sum("quality_score").alias("q"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "profile", "n")))
    return by.agg(F.sum("n").alias("rows"), F.sum("c").alias("chunks"), text.rounded(F.sum("q") / F.sum("n"), 3).alias("mean_quality"), F.array_join(listed, ",").alias("profiles"), F.lit(",".join(datasets.text_columns(documents(spark, sf_dir)))).alias("columns_used"))


def ingest_report(spark, sf_dir):
    by = text.mean_in_order(scored(spark, sf_dir), ["source"], "doc_id", "quality_score", chunks=F.sum("chunks"), chars=F.sum("chars"))
    return by.select("source", "chunks", "chars", text.rounded(F.col("_mean"), 3).alias("score"))


def report(spark, sf_dir):
    """All that is known of each document in one row: its text, chunks, analysis, quality, parameters and layout. What a
    document tells alone is made in one pass over it; only the layout's counts come from another."""
    parts = F.coalesce(chunking.sentence_array(F.col("text")), F.array().cast("array<string>"))
    quality = F.struct("alpha_ratio", "ocr_noise_ratio", "broken_line_ratio", "table_density", "avg_sentence_length", F.array_join("issue_tags", ",").alias("issue_tags"), "quality_score")
    d = text.chunk_params(text.signals(documents(spark, sf_dir))).select("doc_id", "text", quality.alias("quality"), F.struct("profile", "size", "overlap", "tokens").alias("params"))
    d = characters.analyze_text(d, "text")
    own = d.select("doc_id", "text", parts.alias("chunks"), "quality", F.struct("characters", F.array_join(F.array_sort(F.map_keys("types")), ",").alias("types")).alias("analysis"), "params")
    shape = layout.layout_summary(blocks(spark, sf_dir)).select("doc_id", "pages", "blocks")
    return own.join(shape, "doc_id", "left")


def document_report(spark, sf_dir):
    """The report with its fields as columns, and chunks as text with a blank line between them."""
    return report(spark, sf_dir).select("doc_id", "text", F.array_join("chunks", "\n\n").alias("chunks"), "quality.*", "analysis.*", "params.*", "pages", "blocks")


QUERIES = (
    read_dataset, limit_rows, combine_columns, project_metadata, discover_datasets, discovered_rows, filter_supported, admit_by_quota, write_chunks, write_splits, delete_dataset, list_datasets, has_points, assemble_sheets, assemble_paragraphs,
    char_classes, analyze_text, analyze_chunks, resolve_chunk_params, noise_blocks, classify_blocks, layout_to_text, layout_summary, vertical_overlap,
    split_paragraphs, split_tables, split_code, adaptive_chunk, recursive_chunk, dedupe_chunks, chunk_metadata, pack_chunks_sql, chunk_size_stats, ingest_summary, ingest_report, document_report,
)

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PARTS = "list_filter(list_transform({}, lambda x: " + TRIM.format("x") + "), lambda x: x <> '')"
FILES = "f AS (SELECT doc_id, source AS dataset, 'doc' || doc_id || '.' || (['pdf', 'TXT', 'exe', 'csv'])[doc_id % 4 + 1] AS path, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes FROM documents)"
BLOCKS = rf"""
b0 AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
b1 AS (SELECT *, k // 60 AS page, ((k // 2) % 30) * 26.0::DOUBLE + 5 AS y0, 30.0::DOUBLE + 280 * (k % 2) AS x0, 9.0::DOUBLE + (length(text) * 7) % 12 AS font, {TRIM.format("text")} AS t FROM b0),
b2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0) - 1 AS place,
  length(t) < 3 OR regexp_matches(t, '{layout.FOOTER}') OR regexp_matches(t, '{layout.HEADER}') AS noise FROM b1),
b AS (SELECT *, CASE WHEN noise THEN 'noise' WHEN (y0 + 20) / 800 > 0.92 THEN 'footer' WHEN y0 / 800 < 0.08 THEN 'header' WHEN font >= 18 THEN 'title' WHEN font >= 13.5 THEN 'heading'
  WHEN regexp_matches(text, '\|.*\|.*\|') THEN 'table' WHEN regexp_matches(t, '^([-*•]|\d+[.)])\s+') THEN 'list_item' WHEN regexp_matches(t, '^["“”]') THEN 'quote'
  WHEN x0 > 30 AND regexp_matches(text, '[{{}}]|    ') THEN 'code' ELSE 'paragraph' END AS kind FROM b2)"""


def class_sql(of: str, key: str) -> str:
    """Counts per character class over (key, t): each class is taken out of what the ones before have left."""
    steps, counts, left = [f"c0 AS (SELECT {key}, coalesce(t, '') AS t, coalesce(t, '') AS t0 FROM ({of}))"], [], "t0"
    for i, (name, p) in enumerate(characters.CLASSES):
        if p:
            steps.append(f"c{len(steps)} AS (SELECT *, regexp_replace({left}, '{p.replace(chr(92) + 'p{Is', chr(92) + 'p{')}', '', 'g') AS t{i + 1} FROM c{len(steps) - 1})")
            counts.append(f"(length({left}) - length(t{i + 1}))" + (f" - length({latin}) + length(regexp_replace({latin}, '[\\p{{Lu}}\\p{{Ll}}]', '', 'g'))" if name == "alphabetic" else "") + f" AS {name}")
            left = f"t{i + 1}"
        else:
            latin = f"regexp_replace({left}, '\\P{{Latin}}', '', 'g')"
            counts.append(f"length({latin}) - length(regexp_replace({latin}, '\\p{{{'Lu' if name == 'latin_upper' else 'Ll'}}}', '', 'g')) AS {name}")
    return ", ".join(steps) + f", cc AS (SELECT {key}, length(t) AS characters, {', '.join(counts)}, length({left}) AS other FROM c{len(steps) - 1})"


def oracle_sql(signals: str, profiled: str, r, sentences: str) -> dict:
    total = " + ".join(characters.LETTERS)
    ratio = f"CASE WHEN characters > 0 THEN {r(f'({total}) / characters::DOUBLE')} ELSE 0 END AS alpha_ratio"
    types = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {n} > 0 THEN '{n}' END" for n in characters.NAMES) + "], lambda x: x IS NOT NULL))"
    presets = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in text.PROFILES.items())
    picks = ", ".join(f"max(CASE WHEN k = floor(n * {p}::DOUBLE) + 1 THEN c END) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.99))
    spaced = "SELECT doc_id, replace(text, '{}', {}) AS text FROM documents"
    paragraphs = PARTS.format(r"string_split(regexp_replace(text, '\n\s*\n+', chr(1), 'g'), chr(1))")
    listed = lambda l, i, v, src: f"SELECT doc_id, unnest(range(len(l)))::INT AS {i}, unnest(l) AS {v} FROM (SELECT doc_id, {l} AS l FROM ({src}))"  # noqa: E731, E741
    scored = f"{signals}, {profiled}, n AS (SELECT doc_id, count(*) AS chunks FROM ({sentences}) GROUP BY doc_id), d AS (SELECT p.*, coalesce(chunks, 0) AS chunks FROM profiled p LEFT JOIN n USING (doc_id))"
    report = f"{signals}, {profiled}, {BLOCKS}, {class_sql('SELECT doc_id, text AS t FROM documents', 'doc_id')}, g AS (SELECT doc_id, count(DISTINCT page)::INT AS pages, count(*) AS blocks FROM b GROUP BY doc_id), k AS (SELECT doc_id, string_agg(sentence, chr(10) || chr(10) ORDER BY sentence_index) AS chunks FROM ({sentences}) GROUP BY doc_id)"
    return {
        "document_report": f"WITH {report} SELECT d.doc_id, d.text, coalesce(k.chunks, '') AS chunks, p.alpha_ratio, ocr_noise_ratio, broken_line_ratio, table_density, avg_sentence_length, issue_tags, quality_score, cc.characters, array_to_string({types}, ',') AS types, p.profile, v.size, v.overlap, v.tokens, pages, blocks FROM documents d JOIN profiled p USING (doc_id) JOIN cc USING (doc_id) JOIN (VALUES {presets}) AS v(profile, size, overlap, tokens) USING (profile) LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)",
        "read_dataset": "SELECT * FROM labels",
        "limit_rows": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
        "combine_columns": "SELECT doc_id, combined FROM (SELECT doc_id, concat_ws(chr(10), CASE WHEN trim(source) <> '' THEN 'Source: ' || trim(source) END, CASE WHEN trim(lang) <> '' THEN 'Lang: ' || trim(lang) END, CASE WHEN trim(text) <> '' THEN 'Text: ' || trim(text) END, 'N Chars: ' || n_chars) AS combined FROM documents) WHERE combined <> ''",
        "project_metadata": "SELECT doc_id, source, lang, n_chars::VARCHAR AS n_chars, 'unknown' AS _source_file FROM documents",
        "discovered_rows": " UNION ALL ".join(f"SELECT '{t}' AS dataset_id, count(*) AS rows, '{c}' AS columns, count(*) AS counted FROM {t}" for t, c in (("documents", "doc_id,text,lang,source,n_chars"), ("benchmark", "item_id,text"), ("labels", "doc_id,quality,toxic"), ("pages", "page_id,url,html"))),
        "filter_supported": f"WITH {FILES} SELECT doc_id, path FROM f WHERE doc_id % 4 <> 2",
        "admit_by_quota": f"WITH RECURSIVE {FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) AS k FROM f), a AS (SELECT dataset, doc_id, k, bytes <= 20000 AS admitted, CASE WHEN bytes <= 20000 THEN bytes ELSE 0 END AS held FROM o WHERE k = 1 UNION ALL SELECT o.dataset, o.doc_id, o.k, o.bytes <= 20000 AND held + o.bytes <= 60000, CASE WHEN o.bytes <= 20000 AND held + o.bytes <= 60000 THEN held + o.bytes ELSE held END FROM a JOIN o ON a.dataset IS NOT DISTINCT FROM o.dataset AND o.k = a.k + 1) SELECT doc_id, admitted FROM a",
        "write_chunks": f"SELECT doc_id, sentence_index, printf('%d.chunk-%04d', doc_id, sentence_index) AS name FROM ({sentences})",
        "write_splits": "SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows FROM documents GROUP BY 1",
        "delete_dataset": "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM (SELECT min(source) FROM documents)",
        "list_datasets": "SELECT source, count(*) AS points, (SELECT count(DISTINCT source) FROM documents) AS total FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY source LIMIT 5 OFFSET 2",
        "has_points": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS indexed FROM documents",
        "assemble_sheets": "SELECT conv_id, '[Sheet: ' || conv_id || ']' || chr(10) || string_agg(coalesce(turn::VARCHAR, '') || ',' || coalesce(role, '') || ',' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
        "assemble_paragraphs": f"SELECT conv_id, {TRIM.format('string_agg(text, chr(10) ORDER BY turn)')} AS text FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id",
        "char_classes": f"WITH {class_sql('SELECT doc_id, text AS t FROM documents', 'doc_id')} SELECT * EXCLUDE (characters) FROM cc",
        "analyze_text": f"WITH {class_sql('SELECT doc_id, text AS t FROM documents', 'doc_id')} SELECT doc_id, characters, {ratio}, array_to_string({types}, ',') AS types FROM cc",
        "analyze_chunks": f"WITH {class_sql('SELECT doc_id, paragraph_index, paragraph AS t FROM (' + listed(paragraphs, 'paragraph_index', 'paragraph', 'documents') + ')', 'doc_id, paragraph_index')} SELECT doc_id, paragraph_index, characters, {ratio} FROM cc",
        "resolve_chunk_params": f"WITH {signals}, {profiled} SELECT doc_id, p.profile, size, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 * 10 END, 0), overlap)::INT AS overlap, tokens FROM profiled p JOIN (VALUES {presets}) AS v(profile, size, overlap, tokens) USING (profile)",
        "noise_blocks": f"WITH {BLOCKS} SELECT doc_id, page, place FROM b WHERE noise",
        "classify_blocks": f"WITH {BLOCKS} SELECT doc_id, page, place, kind FROM b",
        "layout_to_text": f"WITH {BLOCKS} SELECT doc_id, {TRIM.format('txt')} AS text FROM (SELECT doc_id, string_agg(CASE kind WHEN 'title' THEN chr(10) || '## ' WHEN 'heading' THEN chr(10) || '### ' WHEN 'table' THEN chr(10) || '[TABLE]' || chr(10) ELSE '' END || text || chr(10), chr(10) ORDER BY page, place) AS txt FROM b WHERE kind NOT IN ('noise', 'footer', 'header') GROUP BY doc_id)",
        "layout_summary": f"WITH {BLOCKS}, k AS (SELECT doc_id, kind, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page)::INT AS pages, count(*) AS blocks FROM b GROUP BY doc_id) SELECT doc_id, any_value(pages) AS pages, any_value(blocks) AS blocks, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM k JOIN p USING (doc_id) GROUP BY doc_id",
        "vertical_overlap": f"WITH {BLOCKS} SELECT x.doc_id, x.page, x.place AS a, y.place AS b FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.page = y.page AND x.place < y.place AND abs(x.y0 - y.y0) < 10",
        "split_paragraphs": listed(paragraphs, "paragraph_index", "paragraph", spaced.format(". ", "'.' || chr(10) || ' ' || chr(10)")),
        "split_tables": listed(PARTS.format(r"string_split(regexp_replace(text, '\n(\[Sheet:|\||\d+,)', chr(1) || '\1', 'g'), chr(1))"), "part_index", "part", spaced.format(". ", "'.' || chr(10) || '| '")),
        "split_code": "SELECT doc_id, segment_index, starts_with(s, chr(2)) AS is_code, replace(s, chr(2), '') AS segment FROM (" + listed(PARTS.format(r"string_split(regexp_replace(text, '(?s)(```.*?```|`[^`\n]+`)', chr(1) || chr(2) || '\1' || chr(1), 'g'), chr(1))"), "segment_index", "s", spaced.format(", ", "', `x = 1` '")) + ")",
        "dedupe_chunks": f"SELECT doc_id, sentence, min(sentence_index) AS sentence_index FROM ({sentences}) GROUP BY doc_id, sentence",
        "chunk_metadata": f"WITH {signals}, {profiled} SELECT doc_id, sentence_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, p.source, lang, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, quality_score, profile, 'hashed-words-64' AS embedding_model, 'word-counts' AS sparse_model FROM ({sentences}) JOIN profiled p USING (doc_id) JOIN documents USING (doc_id)",
        "chunk_size_stats": f"SELECT 'all' AS \"of\", max(n) AS n, {picks}, min(c) AS least, max(c) AS most, {r('avg(c)')} AS mean FROM (SELECT length(sentence) AS c, row_number() OVER (ORDER BY length(sentence)) AS k, count(*) OVER () AS n FROM ({sentences}))",
        "ingest_summary": f"WITH {scored} SELECT sum(n)::BIGINT AS rows, sum(c)::BIGINT AS chunks, {r('sum(q) / sum(n)', 3)} AS mean_quality, string_agg(profile || ':' || n, ',' ORDER BY profile) AS profiles, 'text' AS columns_used FROM (SELECT profile, count(*) AS n, sum(chunks) AS c, sum(quality_score) AS q FROM d GROUP BY profile)",
        "ingest_report": f"WITH {scored} SELECT source, sum(chunks)::BIGINT AS chunks, sum(length(t))::BIGINT AS chars, {r('avg(quality_score)', 3)} AS score FROM d GROUP BY source",
    }

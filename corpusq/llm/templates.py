"""Line dedup by a log-template tree."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, written

NUMBER, ANY = "<#>", "<*>"
#: A word with a digit; looked for only where a word begins, so that long words are read once.
NUMBERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked(line: Column) -> Column:
    """The words of a line with one space between them; those with a digit become <#>. Empty for a line without words."""
    spaced = F.when(line.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(line, SPACE, " ")).otherwise(line)
    return F.trim(F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, NUMBERED, NUMBER)).otherwise(spaced))


def line_table(docs: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """One row per line with a word: id, leaf (word count and first words), hash of the masked line, and the line."""
    d = docs.select(F.col(doc_id).alias("_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("_all"))
    d = d.select("_id", F.explode(F.filter(F.transform("_all", masked), lambda m: m != "")).alias("_m"))
    n_words = F.length("_m") - F.length(F.replace("_m", F.lit(" "), F.lit(""))) + 1
    return d.select("_id", F.xxhash64(n_words, F.substring_index("_m", " ", depth)).alias("_leaf"), F.xxhash64("_m").alias("_line"), "_m")


def recurring(lines: DataFrame, limit: Column, limits: DataFrame, depth: int, fixed: float) -> DataFrame:
    """(_leaf, _templates, _fixed) of each leaf with templates that recur in more documents than the limit: these
    templates, and all fixed words of the leaf as 'position word'.

    A document, told by its id, counts once for a line, leaf, word or template, however many of its lines have it. A
    leaf of the tree is kept only if it is above the limit itself. There a word is fixed at its position if it is
    above the limit there, else variable; a template needs a share of `fixed` fixed words, numbers among them. Lines
    are counted by their hashes; the words of those in kept leaves alone are shuffled.
    """
    over = lambda df, n: df.crossJoin(F.broadcast(limits)).where(F.col(n) > limit).drop(*limits.columns)  # noqa: E731  one row
    uses = written(lines.select("_leaf", "_line", "_id").distinct(), "uses")
    by_line = written(uses.groupBy("_leaf", "_line").agg(F.count(F.lit(1)).alias("_n")), "lines")

    def above(keyed: DataFrame, keys: list[str], name: str) -> DataFrame:
        """The keys that more documents have than the limit, of rows (keys, _leaf, _line, _n). A key's documents are
        as many as those of its commonest line at least and of all its lines at most; only where the limit
        lies between are documents met and counted."""
        may = written(over(keyed.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most")), "_all"), name)
        sure = over(may, "_most").select(*keys)
        open_ = may.crossJoin(F.broadcast(limits)).where(F.col("_most") <= limit).select(*keys)
        met = keyed.join(open_, keys, "left_semi").select(*dict.fromkeys([*keys, "_leaf", "_line"])).join(uses, ["_leaf", "_line"])
        counts = met.groupBy(*keys, "_id").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
        return sure.unionByName(over(counts, "_all").select(*keys))

    leaves = written(above(by_line, ["_leaf"], "may-leaves"), "leaves")
    texts = lines.select("_leaf", "_line", "_m").join(leaves, "_leaf", "left_semi").groupBy("_leaf", "_line").agg(F.max("_m").alias("_m"))
    own = written(by_line.join(texts, ["_leaf", "_line"]), "leaf-lines")
    # the first words are those of the leaf, above the limit with it: fixed
    rest = F.slice(F.split("_m", " ", -1), F.lit(depth + 1), F.size(F.split("_m", " ", -1)))
    words_at = own.select("_leaf", "_line", "_n", F.posexplode(rest).alias("_pos", "_word")).withColumn("_pos", F.col("_pos") + depth)
    fixed_words = above(words_at, ["_leaf", "_pos", "_word"], "may-words")
    # per leaf: a position has at most (lines of the leaf / limit) fixed words, which does not grow with the documents
    per_leaf = written(fixed_words.groupBy("_leaf").agg(F.collect_set(F.concat_ws(" ", "_pos", "_word")).alias("_fixed")), "fixed-words")
    template = F.transform(F.split("_m", " ", -1), lambda w, i: F.when((i < depth) | F.array_contains("_fixed", F.concat_ws(" ", i, w)) | (w == NUMBER), w).otherwise(F.lit(ANY)))
    parts = own.join(per_leaf, "_leaf", "left").select("_leaf", "_line", "_n", template.alias("_template"))
    parts = parts.where(F.size(F.filter("_template", lambda w: w != ANY)) / F.size("_template") >= fixed)
    made = written(parts.select("_leaf", "_line", "_n", F.array_join("_template", " ").alias("_template")), "templates")
    tops = above(made, ["_leaf", "_template"], "may-templates").groupBy("_leaf").agg(F.collect_set("_template").alias("_templates"))
    return tops.join(per_leaf, "_leaf", "left")


class Tree:
    """The recurring templates by leaf, in the tasks that read the texts. Words are bytes between ASCII white space."""

    has_digit = staticmethod(re.compile(rb"[0-9]").search)

    def __init__(self, leaves: Iterable[tuple[list[str], list[str] | None]], depth: int) -> None:
        self.depth = depth
        self.leaves: dict[tuple, tuple[set, set]] = {}
        for templates, fixed in leaves:
            known = {tuple(t.encode().split(b" ")) for t in templates}
            at = (f.encode().split(b" ", 1) for f in fixed or ())
            one = next(iter(known))
            self.leaves[len(one), one[:depth]] = known, {(int(k), w) for k, w in at}

    def recurs(self, words: list[bytes]) -> bool:
        mask = lambda ws: tuple(NUMBER.encode() if self.has_digit(w) else w for w in ws)
        first = mask(words[: self.depth])
        leaf = self.leaves.get((len(words), first))
        if leaf is None:
            return False
        known, fixed = leaf
        rest = mask(words[self.depth :])
        return first + tuple(w if w == NUMBER.encode() or (i, w) in fixed else ANY.encode() for i, w in enumerate(rest, self.depth)) in known

    def cut(self, texts: pa.Array) -> pa.Array:
        """For each text: what is left of it, its lines with a word, and how many of them went."""
        left, n_lines, n_dropped = [], [], []
        for t in texts.cast(pa.large_binary()):
            lines = (t.as_py() or b"").split(b"\n")
            words = [x.split() for x in lines]
            stay = [x for x, w in zip(lines, words) if not w or not self.recurs(w)]
            n_lines.append(sum(map(bool, words)))
            n_dropped.append(len(lines) - len(stay))
            left.append(b"\n".join(stay).decode() if t.is_valid else None)
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["left", "n_lines", "n_dropped"])


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 2, fixed: float = 0.75, min_docs: int = 10, share: float = 0.001) -> DataFrame:
    """The documents without lines of templates that recur in more than `min_docs` documents and more than `share`
    of all of them. Adds n_lines (with a word) and n_dropped; n_chars, if there, follows the text.

    Lines are parsed by a tree of fixed depth: word count, then the first `depth` words. The tree of all recurring
    templates goes to every task, where each text is parsed against it, so texts are not shuffled. Each template, and
    each fixed word, stands in more than a `share` of the documents: there are at most (mean lines of a document) /
    share templates and (mean words of a document) / share fixed words, however many documents there are.

    Blank lines and the other lines stay as they are. Null text: null, no lines. Rows that share an id, or have none,
    count as one document; each loses its own lines. Repeated rows are alike. Very long lines are parsed whole.
    Columns named n_lines or n_dropped are replaced, others stay. Empty table: empty result.
    """
    lines = written(line_table(docs, doc_id, text, depth), "line-table")
    limits = docs.agg(F.count(F.lit(1)).alias("_docs"))
    leaves = recurring(lines, F.greatest(F.lit(min_docs), F.col("_docs") * share), limits, depth, fixed)
    tree = Tree(((r._templates, r._fixed) for r in leaves.collect()), depth)
    cut = F.arrow_udf(lambda t: tree.cut(t), "left string, n_lines long, n_dropped long")
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    made = free_name(docs, "_made")
    d = docs.select(*own, cut(text).alias(made))
    d = d.withColumn(text, F.col(f"{made}.left")).withColumn("n_lines", F.col(f"{made}.n_lines")).withColumn("n_dropped", F.col(f"{made}.n_dropped"))
    if "n_chars" in own:
        d = d.withColumn("n_chars", F.length(text).cast("long"))
    return d.select(*own, "n_lines", "n_dropped")

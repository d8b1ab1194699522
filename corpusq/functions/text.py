"""Text-quality signals, score and chunk profile as native expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions import codes

#: The character classes that the signals are defined by.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NW = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOISE = r"_{5,}|\.{4,}|~{3,}|\^{3,}"
LETTERS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉\p{L}\p{P}\p{S}\p{M}]"
BROKEN = rf"[\p{{L}}\p{{N}}_]{{3,}}{WS}*\z"
SCRIPTS = (r"\p{IsLatin}", r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{3002}\x{3007}", r"\p{IsArabic}", r"\p{IsCyrillic}", r"\p{IsHangul}")
#: The characters of WS, for trimming.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
ENDS = ".!?。！？"
HEADER = rf"\A{WS}*(page{WS}+\p{{Nd}}+|chapter{WS}+\p{{Nd}}|section{WS}+\p{{Nd}}|©|\||\*{{3,}}|confidential|draft)"
TABLE = rf"(?s)\A{WS}*\|.*\|.*\|"
#: Size, overlap and tokens of the chunk profiles.
PROFILES = {"clean_text": (1500, 200, 600), "ocr_noisy": (600, 150, 250), "table_heavy": (800, 100, 350), "code_mixed": (700, 120, 300), "general": (1200, 180, 500)}


def rounded(x: Column, places: int) -> Column:
    """Half up by floor, the same in every engine."""
    return F.floor(x * 10**places + F.lit(0.5)) / F.lit(float(10**places))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def script_runs() -> str:
    """A run of characters of one script family; what is in none is a family too."""
    return "|".join([*(f"[{x}]+" for x in SCRIPTS), f"[^{''.join(SCRIPTS)}]+"])


#: What a signal needs to know of a character, as bits: the patterns, and marks set beside them.
LETTER, SPACE, WORD, DIGIT, END, DELIMITER, BREAK = (1 << i for i in range(7))
COUNTS = ("letters", "noise", "lines", "broken", "header", "table", "repeated", "delimiters", "sentences", "words", "scripts")
#: Words that begin a header line, and those of them that a number must follow; letters that are alike but for their case.
HEADERS = {"page": True, "chapter": True, "section": True, "confidential": False, "draft": False}
ALIKE = {"ſ": "s", "İ": "i", "ı": "i"}


def character_table(spark) -> np.ndarray:
    """For each code point the bits above, and its script family from bit 8 on: those of SCRIPTS, then others."""
    found = codes.table(spark, (LETTERS, WS, r"[\p{L}\p{N}_]", r"\p{Nd}", *(f"[{x}]" for x in SCRIPTS)))
    families = found >> 4
    family = np.full(len(found), len(SCRIPTS), np.uint16)
    for i in reversed(range(len(SCRIPTS))):
        family[(families >> i) & 1 == 1] = i
    family[codes.END_OF_TEXT] = len(SCRIPTS) + 1
    made = (found & 15).astype(np.uint16) | family << 8
    for marks, bit in ((ENDS, END), ("{}[", DELIMITER), ("\n", BREAK)):
        made[[*map(ord, marks)]] |= bit
    made[codes.END_OF_TEXT] |= END | BREAK
    return made


def header_lines(made: np.ndarray, code: np.ndarray, first: np.ndarray, end: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which lines are headers, by where their first character that is not blank stands and where they end."""
    fold = np.arange(0x180, dtype=np.uint32)
    for c in map(chr, range(0x180)):
        fold[ord(c)] = ord(ALIKE.get(c, c.lower() if c.isascii() else c))
    folded = lambda x: np.where(x < 0x180, fold[np.minimum(x, 0x17F)], x)
    code = np.append(code, np.full(16, codes.END_OF_TEXT, np.uint32))
    is_ = lambda at, word: np.logical_and.reduce([folded(code[at + i]) == ord(c) for i, c in enumerate(word)])
    out = np.isin(code[first], [ord("©"), ord("|")]) | is_(first, "***")
    initial = folded(code[first])
    for word, numbered in HEADERS.items():
        at = np.flatnonzero(initial == ord(word[0]))
        at = at[is_(first[at], word)]
        if numbered and len(at):
            after = first[at] + len(word)
            number = np.append(filled, len(code) - 1)[np.searchsorted(filled, after)]
            at = at[(number > after) & (number < end[at]) & (made[code[number]] & DIGIT > 0)]
        out[at] = True
    return out


def text_counts(made: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text. Lines, sentences and runs end with their text, after which END_OF_TEXT stands."""
    what = made[code]
    has = lambda bits: what & bits != 0
    at = lambda places: np.diff(np.searchsorted(places, bounds))
    out = {"letters": codes.per_text(has(LETTER), bounds)}
    start, length, of = codes.long_runs(code)
    long = lambda c, n: (of == ord(c)) & (length >= n)
    out["noise"] = at(start[long("_", 5) | long(".", 4) | long("~", 3) | long("^", 3)])
    alnum = (of >= 48) & (of <= 57) | (of >= 65) & (of <= 90) | (of >= 97) & (of <= 122)
    out["repeated"] = at(start[alnum & (length >= 5)])
    out["delimiters"] = codes.per_text(has(DELIMITER), bounds) + at(start[long(" ", 4)])

    inner = ~has(SPACE | END)
    begins = np.flatnonzero(inner & ~np.append(False, inner[:-1]))
    sentence = np.searchsorted(np.flatnonzero(has(END)), begins)
    out["words"], out["sentences"] = at(begins), at(begins[np.append(True, sentence[1:] != sentence[:-1])[: len(begins)]])

    filled = np.flatnonzero(~has(SPACE))  # END_OF_TEXT is among them
    family = what[filled] >> 8
    changes = np.append(True, family[1:] != family[:-1]) & (family <= len(SCRIPTS))
    out["scripts"] = np.maximum(at(filled[changes]) - 1, 0)

    end = np.flatnonzero(has(BREAK))
    begin = np.append(0, end[:-1] + 1)
    out["lines"] = at(end)
    next_ = np.searchsorted(filled, begin)
    first = filled[next_]
    last = filled[np.searchsorted(filled, end) - 1]
    word = lambda back: what[np.maximum(last - back, 0)] & WORD > 0
    out["broken"] = at(end[(last - 2 >= begin) & (last < end) & word(0) & word(1) & word(2)])
    some = np.flatnonzero(first < end)
    out["header"] = at(end[some[header_lines(made, code, first[some], end[some], filled)]])
    pipes = np.flatnonzero(code == ord("|"))
    some = np.flatnonzero((np.searchsorted(pipes, end) - np.searchsorted(pipes, begin) >= 3) & (code[first] == ord("|")))
    out["table"] = at(end[some])
    return out


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the signals, their tags, the score and the profile; null counts as empty.

    Characters, runs, sentences and lines are counted in one pass over code points; the rest are expressions of the counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    d = codes.counted(docs, text, "_n", text_counts, COUNTS, character_table(docs.sparkSession))
    of = lambda c: F.col("_n").getField(c)
    raw = {
        "alpha_ratio": of("letters") / n,
        "ocr_noise_ratio": of("noise") / n,
        "broken_line_ratio": of("broken") / of("lines"),
        "header_footer_ratio": of("header") / of("lines"),
        "table_density": of("table") / of("lines"),
        "repeated_char_ratio": of("repeated") / n,
        "code_delimiter_ratio": of("delimiters") / n,
    }
    d = d.withColumns({f"_{k}": F.when(F.length(t) > 0, v).otherwise(0.0) for k, v in raw.items()})
    d = d.withColumns({k: rounded(F.col(f"_{k}"), 4) for k in raw})
    d = d.withColumns({"_s": of("sentences"), "_w": of("words"), "script_changes": of("scripts").cast("int")})
    d = d.withColumn("avg_sentence_length", F.when(F.col("_s") > 0, rounded(F.col("_w") / F.col("_s"), 2)).otherwise(0.0))
    tags = [("ocr_noise", "_ocr_noise_ratio", 0.01), ("broken_lines", "_broken_line_ratio", 0.25), ("table_heavy", "_table_density", 0.05), ("header_footer_noise", "_header_footer_ratio", 0.1), ("repeated_chars", "_repeated_char_ratio", 0.005), ("code_delimiters", "_code_delimiter_ratio", 0.03), ("mixed_scripts", "script_changes", 10)]
    named = F.array_compact(F.array(*[F.when(F.col(c) > x, F.lit(t)) for t, c, x in tags]))
    d = d.withColumn("issue_tags", F.when(F.length(t) > 0, named).otherwise(F.array(F.lit("empty"))))
    c = F.col
    score = 1 - 0.4 * c("ocr_noise_ratio") - 0.15 * c("broken_line_ratio") - 0.1 * c("header_footer_ratio") - F.when(c("avg_sentence_length") < 5, 0.1).otherwise(0.0) - 0.3 * c("repeated_char_ratio")
    d = d.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rounded(score, 4))))
    profile = (
        F.when(c("table_density") > 0.05, "table_heavy").when(c("code_delimiter_ratio") > 0.03, "code_mixed").when((c("ocr_noise_ratio") > 0.005) | (c("repeated_char_ratio") > 0.002), "ocr_noisy")
        .when((c("quality_score") >= 0.85) & (F.size("issue_tags") == 0), "clean_text").otherwise("general")
    )
    d = d.withColumn("profile", profile)
    return d.drop("_n", "_s", "_w", *(f"_{k}" for k in raw))


#: Ids whose values are added up by one task, in order.
BLOCK = 100_000


def mean_in_order(d: DataFrame, keys: list[str], key: str, value: str, **sums: Column) -> DataFrame:
    """(keys, _mean, sums): the mean of a column of doubles for each group, added up in the order of `key`.

    Sums of doubles depend on their order, and where a mean stands on the edge of rounding that shows. So blocks of ids are
    added up in order, each by one task, and then the blocks: the same however rows are spread, and as a plain loop adds."""
    added = lambda rows: F.aggregate(F.array_sort(rows), F.lit(0.0), lambda a, x: a + x.v)
    block = d.groupBy(*keys, F.floor(F.col(key) / BLOCK).alias("_b")).agg(F.count(value).alias("_n"), added(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))).alias("_v"), *[x.alias(n) for n, x in sums.items()])
    out = block.groupBy(*keys).agg(F.sum("_n").alias("_n"), added(F.collect_list(F.struct(F.col("_b").alias("k"), F.col("_v").alias("v")))).alias("_v"), *[F.sum(n).alias(n) for n in sums])
    return out.select(*keys, (F.col("_v") / F.col("_n")).alias("_mean"), *sums)


def chunk_params(docs: DataFrame, size: str | None = None, overlap: str | None = None, tokens: str | None = None) -> DataFrame:
    """Adds size, overlap and tokens: a column's value where given and not 0, else that of the row's profile."""
    rows = [(p, *v) for p, v in PROFILES.items()]
    presets = docs.sparkSession.createDataFrame(rows, "profile string, _size int, _overlap int, _tokens int")
    pick = lambda c, preset: (F.coalesce(F.nullif(F.col(c).cast("int"), F.lit(0)), F.col(preset)) if c else F.col(preset))
    d = docs.join(F.broadcast(presets), "profile", "left")  # five rows
    return d.withColumns({"size": pick(size, "_size"), "overlap": pick(overlap, "_overlap"), "tokens": pick(tokens, "_tokens")}).drop("_size", "_overlap", "_tokens")


def estimate_tokens(text: str = "text") -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def truncate(text: Column, n: int, suffix: str = "...") -> Column:
    """The first n characters, with the suffix if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def human_size(n: Column) -> Column:
    """Bytes as B, KB and MB with one place, GB with two; a dash for null."""
    scaled = lambda k, places: F.format_string(f"%.{places}f", rounded(n / float(1024**k), places))
    return (
        F.when(n.isNull(), "—").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(scaled(1, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(scaled(2, 1), F.lit(" MB"))).otherwise(F.concat(scaled(3, 2), F.lit(" GB")))
    )

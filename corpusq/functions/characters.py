"""What kinds of characters texts are made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions import codes
from corpusq.functions.text import WS, rounded

#: The classes in order of precedence; what is left is `other`.
CLASSES = (
    ("whitespace", WS), ("digit", r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"), ("cjk", r"[\p{IsHan}\x{3002}\x{3007}]"), ("hiragana", r"\p{IsHiragana}"), ("katakana", r"\p{IsKatakana}"), ("hangul", r"\p{IsHangul}"),
    ("arabic", r"\p{IsArabic}"), ("cyrillic", r"\p{IsCyrillic}"), ("latin_upper", None), ("latin_lower", None), ("alphabetic", r"\p{L}"), ("punctuation", r"\p{P}"), ("symbol", r"\p{S}"), ("mark", r"\p{M}"),
)
NAMES = tuple(n for n, _ in CLASSES) + ("other",)
#: Classes that are letters.
LETTERS = ("cjk", "hiragana", "katakana", "hangul", "arabic", "cyrillic", "latin_upper", "latin_lower", "alphabetic")


def class_table(spark) -> np.ndarray:
    """For each code point the place of its class in NAMES."""
    patterns = {n: p for n, p in CLASSES if p} | {"latin_upper": r"[\p{IsLatin}&&\p{Lu}]", "latin_lower": r"[\p{IsLatin}&&\p{Ll}]"}
    found = codes.table(spark, tuple(patterns[n] for n, _ in CLASSES))
    made = np.full(len(found), len(CLASSES), np.uint8)
    for i in reversed(range(len(CLASSES))):
        made[(found >> i) & 1 == 1] = i
    return made


def class_counts(made: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    own, n = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), len(NAMES)
    counts = np.bincount(own * n + made[code], minlength=n * (len(bounds) - 1)).reshape(-1, n)
    counts[:, -1] -= 1  # what stands after the text
    return dict(zip(NAMES, counts.T, strict=True))


def char_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds a count per class: each character is in the first class that it fits; null is empty."""
    d = codes.counted(df, text, "_n", class_counts, NAMES, class_table(df.sparkSession))
    return d.withColumns({n: F.col("_n").getField(n) for n in NAMES}).drop("_n")


def letters() -> Column:
    total = F.lit(0)
    for c in LETTERS:
        total = total + F.col(c)
    return total


def analyze_text(df: DataFrame, text: str) -> DataFrame:
    """Adds characters, alpha_ratio (letters alone) and types, a map of the classes that occur."""
    d = char_classes(df, text).withColumn("characters", F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in NAMES]), lambda e: e.value > 0)
    ratio = F.when(F.col("characters") > 0, rounded(letters() / F.col("characters"), 4)).otherwise(0.0)
    return d.withColumn("alpha_ratio", ratio).withColumn("types", F.map_from_entries(pairs)).drop(*NAMES)

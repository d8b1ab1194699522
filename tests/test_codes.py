"""Counts over code points, against the regular expressions that say what they mean."""

import random

from pyspark.sql import functions as F

from corpusq.functions import characters, text

ODD = list("aZbé. .!?。！？\n\n\t\r \x0b\x1c\x85\xa0 　|*©_~^…{}[]0١²⁴₉ⅣßſİıЖяعربي한글漢字かなカナ々〇゛́😀𝒳𐐀½\0﻿‍()")
WORDS = ["page 7", "PAGE ١", "page", "page \n3", "Chapter\t9", "section x", "ſection 1", "confıdential", "CONFİDENTIAL", " draft", "***", "* **", "©", "|a|b|", " |a|b", "____", "_____", "......", "~~~", "^^^^", "     ", "aaaaa", "bbbb", "éééééé", "the end. ", "And so on", "x" * 9]


def made_up(n, seed):
    r = random.Random(seed)
    return [None, "", " ", "\n", "|", ".", *("".join(r.choice(WORDS + ["\n", " "]) if r.random() < 0.4 else r.choice(ODD) for _ in range(r.choice([1, 3, 20, 200]))) for _ in range(n))]


def expected(d):
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n", -1)
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    share = lambda test: F.when(t != "", text.rounded(F.size(F.filter(lines, test)) / F.size(lines), 4)).otherwise(0.0)
    per = lambda x: F.when(t != "", text.rounded(x / n, 4)).otherwise(0.0)
    inner = text.NW.replace("[^", f"[^{text.ENDS}", 1)
    sentences, words = text.count(t, rf"{text.WS}*+{inner}[^{text.ENDS}]*+"), text.count(t, rf"{inner}++")
    return {
        "alpha_ratio": per(text.count(t, text.LETTERS)), "ocr_noise_ratio": per(text.count(t, text.NOISE)), "broken_line_ratio": share(lambda x: x.rlike(text.BROKEN)), "header_footer_ratio": share(lambda x: x.rlike("(?iu)" + text.HEADER)),
        "table_density": share(lambda x: x.rlike(text.TABLE)), "repeated_char_ratio": per(text.count(t, r"([a-zA-Z0-9])\1{4,}")), "code_delimiter_ratio": per(text.count(t, r"[{}\[]") + text.count(t, " {4,}")),
        "avg_sentence_length": F.when(sentences > 0, text.rounded(words / sentences, 2)).otherwise(0.0), "script_changes": F.greatest(text.count(F.regexp_replace(t, f"{text.WS}++", ""), text.script_runs()) - 1, F.lit(0)),
    }


def test_signals_are_those_of_their_patterns(spark):
    d = spark.createDataFrame(list(enumerate(made_up(3000, 5))), "doc_id long, text string").cache()
    want = expected(d)
    got = {r[0]: r for r in text.signals(d).select("doc_id", *want).collect()}
    for w in d.select("doc_id", *[c.alias(k) for k, c in want.items()]).collect():
        assert got[w.doc_id] == w


def test_each_character_is_in_the_first_class_that_it_fits(spark):
    rows = [(i, chr(i)) for i in [*range(0x3200), *range(0x9FF0, 0xA100), *range(0xAC00, 0xAC10), *range(0xFE00, 0x10400), *range(0x1D400, 0x1D500), *range(0x1F5F0, 0x1F610), 0x10FFFF] if not 0xD800 <= i < 0xE000]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    latin = F.col("text").rlike(r"\p{IsLatin}")
    of = {"latin_upper": latin & F.col("text").rlike(r"\p{Lu}"), "latin_lower": latin & F.col("text").rlike(r"\p{Ll}")}
    name = F.coalesce(*[F.when(of[n] if p is None else F.col("text").rlike(p), n) for n, p in characters.CLASSES], F.lit("other"))
    counts = characters.char_classes(d.withColumn("want", name), "text")
    assert counts.where(" + ".join(characters.NAMES) + " <> 1").count() == 0
    assert counts.where(" or ".join(f"(want = '{n}') <> ({n} = 1)" for n in characters.NAMES)).count() == 0
    whole = characters.char_classes(spark.createDataFrame([("".join(c for _, c in rows),), (None,)], "text string"), "text").collect()
    assert [sum(r[1:]) for r in whole] == [len(rows), 0]


def test_texts_are_read_once(spark):
    d = spark.range(9).select(F.concat(F.lit("Some words. "), "id").alias("text"))
    for made in (text.signals(d), characters.char_classes(d, "text")):
        plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
        assert not any(x in plan for x in ("regexp", "rlike", "split(")) and plan.count("arrowevalpython") == 1

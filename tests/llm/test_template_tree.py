"""Lines are masked alike where templates are counted and where texts are parsed against the tree."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusq.llm import templates

ODD = ["a  b\tc9", " x1 2y\r", "no break 7", "a b ٣", "\x1c \x85 q", "<#> <*> 5", "\x0b\x0c", "", "é3 ü", "9", "a" * 5000 + "1 b"]


def test_masks_agree(spark):
    tree = templates.Tree([], 2)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string").select("i", templates.masked(F.col("x")).alias("m")).collect()
    for r in rows:
        words = [b"<#>" if tree.has_digit(w) else w for w in ODD[r.i].encode().split()]
        assert b" ".join(words).decode() == r.m


def test_tree():
    tree = templates.Tree([(["page <#> of <#> in <*>", "page <#> of the <*> here"], ["2 of", "3 the", "4 in", "5 here"]), (["one"], None)], 2)
    text = "page 1 of 22 in all\npage 1 of x in all\npage 7 of the best here\n\none\ntwo\npage a of 22 in all\n \tone"
    got = tree.cut(pa.array([text, None, "", "\n\n", "one"])).to_pylist()
    assert got[0] == {"left": "page 1 of x in all\n\ntwo\npage a of 22 in all", "n_lines": 7, "n_dropped": 4}
    assert got[1] == {"left": None, "n_lines": 0, "n_dropped": 0} and got[2]["left"] == "" and got[3]["left"] == "\n\n"
    assert got[4] == {"left": "", "n_lines": 1, "n_dropped": 1}


def test_clashing_columns_and_many_rows(spark):
    rows = [(i, f"visit page {i} of the site\nown line {chr(97 + i % 26) * (i + 1)}", "m", 7) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _made string, n_lines int").repartition(3)
    got = templates.drop_recurring(d).collect()
    assert {(r.doc_id, r.text, r._made, r.n_lines, r.n_dropped) for r in got} == {(i, t.split("\n")[1], "m", 2, 1) for i, t, *_ in rows}

"""Lines count by distinct documents: inner lines of a block count, repeats inside a document do not."""

import collections
import random
import re

import pytest

from corpusq.llm import quality, templates

VOCABULARY = [a + b for a in "the ba na lo ré ti".split() for b in "and s on er ly zu".split()]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    own = lambda n=30: " ".join(rnd.choices(VOCABULARY, k=n))
    made = [(i, f"{own()}\n{own()}\nfirst of the block here\nmiddle of the block here\nlast of the block here\n{own()}") for i in range(30)]
    made += [(100 + i, "the only line there is in it") for i in range(15)]
    made += [(200, "\n".join(x for _ in range(20) for x in (own(9), "said again and again here"))), (201, own() + "\nsaid again and again here")]
    made += [(300, "\n".join(f"many kinds {w} of a line" for w in VOCABULARY)), (301, None), (302, "")]
    # one template by lines that each stand in few documents, three of them in each
    made += [(400 + i, "\n".join([own(), *(f"visit our {VOCABULARY[(i + k) % 12]} shop in the old town now" for k in range(3))])) for i in range(12)]
    return made


def test_quality_lines(spark, rows):
    d = spark.createDataFrame([(i, t, "s" if i % 7 else None) for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r.removed_words for r in quality.quality_rules(d, min_docs=3).collect()}
    docs_of, size = collections.defaultdict(set), collections.Counter()
    for i, t in rows:
        size[i % 7 > 0] += 1
        for x in (t or "").split("\n"):
            docs_of[i % 7 > 0, x].add(i)
    common = {k for k, v in docs_of.items() if k[1] and len(v) > max(3, 0.02 * size[k[0]])}
    assert got == {i: sum(len(x.split()) for x in (t or "").split("\n") if (i % 7 > 0, x) in common) for i, t in rows}
    assert got[0] == 15 and got[100] == 7 and got[200] == got[201] == 0


def brute_recurring(rows, limit, depth=2, fixed=0.75):
    lines = [(i, re.findall(r"[^\x20\x09-\x0D]+", x)) for i, t in rows for x in (t or "").split("\n") if x.strip()]
    leaves, words, tops = (collections.defaultdict(set) for _ in range(3))
    leaf = lambda w: (len(w), *w[:depth])
    for i, w in lines:
        leaves[leaf(w)].add(i)
    kept = [(i, w) for i, w in lines if len(leaves[leaf(w)]) > limit]
    for i, w in kept:
        for k, x in enumerate(w):
            words[leaf(w), k, x].add(i)
    template = lambda w: tuple(x if k < depth or len(words[leaf(w), k, x]) > limit else "<*>" for k, x in enumerate(w))
    for i, w in kept:
        tops[template(w)].add(i)
    return {" ".join(w) for i, w in kept if len(tops[template(w)]) > limit and sum(x != "<*>" for x in template(w)) >= fixed * len(w)}


def test_templates(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_recurring(rows, 10)
    got = {r.doc_id: r.text for r in templates.drop_recurring(d).collect()}
    assert got == {i: t if t is None or not any(x in gone for x in t.split("\n")) else "\n".join(x for x in t.split("\n") if x not in gone) for i, t in rows}
    assert "middle of the block here" in gone and "said again and again here" not in gone and "many kinds naer of a line" not in gone and any(x.startswith("visit our") for x in gone)

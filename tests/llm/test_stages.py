"""The stages one after the other on a small corpus, against brute force."""

import collections
import random
import re

import corpus_pipeline
from corpusq.llm import pieces
from corpusq.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "the ba na lo re ti".split() for b in "and s on er ly zu".split()]
WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    rnd = random.Random(12)
    own = lambda n: " ".join(rnd.choices(WORDS, k=n))
    rows = []
    for i in range(60):
        foot = "\nAll rights to this page are kept" if i % 2 else ""
        rows.append((i, f"{own(70)}\nseen {i} times by the readers of page {i}\n{own(30)}{foot}", "en", f"s{i % 3}", 0))
    rows += [(100, rows[3][1], "en", "s0", 0), (101, "too short", "en", "s1", 0), (102, None, "en", None, 0), (103, "again and again " * 40, "en", "s2", 0), (None, own(90), "en", None, 0)]
    return rows


def brute_quality(rows):
    docs, hosts = collections.defaultdict(set), collections.Counter(r[3] for r in rows)
    norm = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if re.search(WORD, x):
                docs[r[3], norm(x)].add(r[0])
    common = {k for k, d in docs.items() if len(d) > 10 and len(d) > 0.02 * hosts[k[0]]}
    out = []
    for r in rows:
        w = re.findall(WORD, r[1] or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        gone = [x for x in (r[1] or "").split("\n") if re.search(WORD, x) and (r[3], norm(x)) in common]
        if len(w) >= 50 and 2 * len(repeated) <= len(w) and sum(len(re.findall(WORD, x)) for x in gone) <= 0.5 * len(w):
            text = "\n".join(x for x in r[1].split("\n") if not (re.search(WORD, x) and (r[3], norm(x)) in common))
            out.append((r[0], text, r[3]))
    return out


def brute_lines(rows):
    mask = lambda x: ["<#>" if re.search("[0-9]", w) else w for w in re.findall(WORD, x)]
    lines = [(r[0], k, mask(x)) for r in rows for k, x in enumerate((r[1] or "").split("\n")) if re.search(WORD, x)]
    limit = max(10, 0.001 * len(rows))
    leaf = lambda m: (len(m), *m[:2])
    of_leaf, of_word, of_template = (collections.defaultdict(set) for _ in range(3))
    for i, _, m in lines:
        of_leaf[leaf(m)].add(i)
        for p, w in enumerate(m):
            of_word[leaf(m), p, w].add(i)
    template = lambda m: tuple(w if p < 2 or w == "<#>" or len(of_word[leaf(m), p, w]) > limit else "<*>" for p, w in enumerate(m))
    fits = lambda m: len(of_leaf[leaf(m)]) > limit and sum(w != "<*>" for w in template(m)) >= 0.75 * len(m)
    for i, _, m in lines:
        if fits(m):
            of_template[leaf(m), template(m)].add(i)
    gone = {(i, k) for i, k, m in lines if fits(m) and len(of_template[leaf(m), template(m)]) > limit}
    return [(r[0], "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k) not in gone), r[2]) for r in rows]


def plain(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)


def test_stages(spark):
    rows = corpus()
    made, docs = [], spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = written(step(spark, docs, ""), f"test-stage-{k}")
        made.append(docs)
    want = brute_quality(rows)
    assert len(want) == 62 and plain(made[0]) == sorted(want, key=repr)
    want = brute_lines(want)
    assert plain(made[1]) == sorted(want, key=repr)
    assert all(made[k].columns == [c.split()[0] for c in SCHEMA.split(", ")] for k in range(4))
    kept = plain(made[2])
    assert len(kept) == len(want) - 1 and set(kept) <= set(want)  # one exact copy goes
    size = lambda t: len(re.findall(WORD, t or ""))
    times = collections.Counter(plain(made[3]))
    assert set(times) <= set(kept) and max(times.values()) <= 3
    sizes = collections.Counter()
    for r in kept:
        sizes[r[2]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s))
    left, target = dict(zip(order, (1, 2, 3, 1))), {}
    rest = sum(sizes.values())
    while any(rest * w / sum(left.values()) > 3 * sizes[s] for s, w in left.items()):
        full = {s for s, w in left.items() if rest * w / sum(left.values()) > 3 * sizes[s]}
        for s in full:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            del left[s]
    target |= {s: rest * w / sum(left.values()) for s, w in left.items()}
    for s in order:
        assert abs(sum(n * size(r[1]) for r, n in times.items() if r[2] == s) - target[s]) <= 60
    p = pieces.Pieces(open(pieces.MODEL, "rb").read())
    import pyarrow as pa

    assert all(r.token_ids == pieces.encoded(p, pa.array([r.text])).to_pylist()[0] for r in made[4].collect()) and made[4].count() == sum(times.values())

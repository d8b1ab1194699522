import numpy as np
import pyarrow as pa
from corpusq.llm import graph
from corpusq.llm.jaccard import Forest, exact_links


def named(n, links):
    forest, first = Forest(n), {}
    for a, b in links:
        forest.join(a, b)
    return [first.setdefault(forest.root(i), i) for i in range(n)]


def counting(monkeypatch):
    tables, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or written(df, name))
    return tables


def test_stars_of_paths_and_strings():
    order = np.random.default_rng(3).permutation(4000)
    a, b = graph.stars(pa.array(order[1:]), pa.array(order[:-1]))
    assert sorted(a.to_pylist()) == list(range(1, 4000)) and set(b.to_pylist()) == {0}
    a, b = graph.stars(pa.array(["é", "b", "z"]), pa.array(["b", "a", "y"]))
    assert sorted(zip(a.to_pylist(), b.to_pylist())) == [("b", "a"), ("z", "y"), ("é", "a")]
    assert [len(x) for x in graph.stars(pa.array([], pa.int64()), pa.array([], pa.int64()))] == [0, 0]


def test_components_of_edges_in_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = [(int(x), int(y)) for x, y in rng.integers(0, 600, (400, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5001 + i) for i in range(300)]
    edges += edges[::3] + [(7, 7), (9999, 9999), (None, 3)]
    monkeypatch.setattr(graph, "EDGES", 50)
    tables = counting(monkeypatch)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = named(6000, [e for e in edges if None not in e and max(e) < 6000])
    nodes = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    assert got == {x: want[x] for x in nodes}
    assert len(tables) > 2


def test_edges_that_meet_in_a_task_need_no_round(spark, monkeypatch):
    """Links of a family leave one task; before, each path took as many rounds as its length asked for."""
    tables = counting(monkeypatch)
    edges = spark.createDataFrame([(100 * k + i, 100 * k + i + 1) for k in range(40) for i in range(90)], "a long, b long").coalesce(1)
    got = graph.components(edges).collect()
    assert len(got) == 40 * 91 and all(r.component == r.node // 100 * 100 for r in got)
    assert tables == ["edges", "edges"]
    assert graph.components(edges.where("a < 0")).collect() == []


def test_exact_links_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90, 100):
        base = [np.unique(rng.integers(0, 1 << 62, 80).astype(np.uint64)) for _ in range(3)]
        sets = []
        for _ in range(90):
            s = base[rng.integers(3)]
            s = np.delete(s, rng.integers(0, len(s), rng.integers(0, 20)))
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 62, rng.integers(0, 6)).astype(np.uint64)])))
        sets.sort(key=len)
        links = list(exact_links(sets, percent))
        pairs = [(i, j) for i in range(90) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
        assert set(links) <= set(pairs) and named(90, links) == named(90, pairs)
        assert len(links) == 90 - len(set(named(90, pairs)))


def test_exact_links_count_a_set_against_many_at_once(monkeypatch):
    """A family of near copies, few of them within the limit of the first: before, each pair was compared by itself."""
    from corpusq.llm import jaccard

    calls, of = [], jaccard.Shared.of
    monkeypatch.setattr(jaccard.Shared, "of", lambda self, x, others: calls.append(len(others)) or of(self, x, others))
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 62, 100).astype(np.uint64))
    sets = [np.concatenate([np.delete(base, rng.permutation(100)[:15]), rng.integers(0, 1 << 62, 15).astype(np.uint64)]) for _ in range(400)]
    sets = [np.unique(s) for s in sets]
    list(jaccard.exact_links(sorted(sets, key=len), 80))
    assert sum(calls) > 400 * 390 / 2 and len(calls) < 400 * 9

"""Connected components, by rounds and at once."""

import random

import pytest

from citeset.operators import graph


@pytest.mark.parametrize("at_once", [0, 10, 1_000_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    r = random.Random(at_once)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(400, 480)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {x for x in root if not any(x in e and e[0] != e[1] for e in edges)}
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges + edges[:50], "a long, b long")).collect()}
    assert got == {x: y for x, y in root.items() if x not in alone}
    named = spark.createDataFrame([(f"é{a}", f"é{b}") for a, b in edges[:80]], "a string, b string")
    assert {x["root"] for x in graph.components(named).collect()} == {"é100", "é400"}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

import random

import pytest

from pathlore.llm import graph


def brute(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, find(i)) for i in root if find(i) != i)


RNG = random.Random(3)
CHAIN = RNG.sample(range(400), 400)
CASES = {
    "empty": [],
    "loops": [(1, 1), (None, 2), (3, None)],
    "random": [(RNG.randrange(-300, 300), RNG.randrange(300)) for _ in range(300)],
    "chain": list(zip(CHAIN, CHAIN[1:], strict=False)),
    "hubs": [(500, i) for i in range(400)] + [(i, 900 + i) for i in range(300)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_against_brute_force(spark, monkeypatch, name):
    """Tasks that hold all their edges, and those that hold three, which cut a node's rows apart."""
    for held in (graph.HELD, 3):
        monkeypatch.setattr(graph, "HELD", held)
        got = graph.components(spark.createDataFrame(CASES[name], "a long, b long").repartition(7))
        assert sorted(tuple(r) for r in got.collect()) == brute(CASES[name])


def test_few_tasks_for_components(spark):
    """Each task leaves two or more files for its shuffle and a line in the event log, so many small ones fill the disk."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, i) for i in range(0, 300, 7)], "a long, b long").repartition(8)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "components")
    try:
        graph.components(edges).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    stages = {s for job in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(job).stageIds}
    assert len(stages) <= 24

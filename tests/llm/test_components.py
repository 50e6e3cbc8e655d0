import random

import pytest

from vectorscape.llm.components import components


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    r = random.Random(parts)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in {x for e in edges if e[0] != e[1] for x in e}}
    df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    assert {x.node: x.root for x in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0

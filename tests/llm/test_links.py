"""Components of links against a plain search."""

import random

from holdfast.llm import links


def plain(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = start
                todo += near[x]
    return label


def test_components_and_how_often_links_are_read(spark, monkeypatch):
    dice = random.Random(3)
    name = list(range(4000))
    dice.shuffle(name)
    pairs = [(name[h], name[m]) for m in range(3, 1500) for h in range(3)]  # members on the same three centres
    pairs += [(name[i], name[i + 1]) for i in range(2000, 2100)]  # a chain
    pairs += [(3500 + i, 3501 + i) for i in range(60)] + [(dice.randrange(2200, 3400), dice.randrange(2200, 3400)) for _ in range(500)]
    pairs += [(5000, 5000), (6000, 6001), (6001, 6000)]
    made, stored = [], links.stored
    monkeypatch.setattr(links, "stored", lambda df, n: made.append((n, out := stored(df, n))) or out)
    got = links.connected(spark.createDataFrame(pairs, "a long, b long").repartition(3))
    assert {r["node"]: r["label"] for r in got.collect()} == plain(pairs) and got.count() == len(plain(pairs))
    sizes = [df.count() for n, df in made if n == "links"]
    assert len(sizes) == 2 and sizes[1] < 0.5 * sizes[0]
    alone = links.connected(spark.createDataFrame([(1, 2), (2, 1), (4, 4)], "a long, b long"))
    assert sorted(map(tuple, alone.collect())) == [(1, 1), (2, 1), (4, 4)]
    assert links.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_families_join_components_without_reading_all_links_again(spark, monkeypatch):
    first = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (7, 7), (8, 7)], "node long, label long")
    made, stored = [], links.stored
    monkeypatch.setattr(links, "stored", lambda df, n: made.append(n) or stored(df, n))
    further = links.joined(spark.createDataFrame([(4, 2), (2, 4), (4, 9), (8, 7)], "a long, b long"), first)
    assert {r["node"]: r["label"] for r in further.collect()} == {1: 1, 3: 1, 9: 1}
    ends = spark.createDataFrame([(x,) for x in (1, 2, 4, 8, 9, 10)], "label long")
    for labels in (first, further):
        ends = links.relabelled(ends, "label", labels)
    assert sorted(r["label"] for r in ends.collect()) == [1, 1, 1, 1, 7, 10]
    assert made[0] == "links" and made.count("links") == 1
    assert links.joined(spark.createDataFrame([(1, 2), (8, 8)], "a long, b long"), first) is None

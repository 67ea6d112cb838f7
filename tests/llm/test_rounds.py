"""Components take few rounds on stars, as crowds of near copies are."""

import random

from helpers import groups

from tidepoint.llm import graph


def test_stars_and_chains_take_few_rounds(spark, monkeypatch):
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    ids = random.Random(8).sample(range(10**6), 700)
    stars = [(ids[k - k % 100], ids[k]) for k in range(600) if k % 100]
    stars += [(ids[0], ids[100]), (ids[101], ids[200])]  # of hubs, and of a leaf and a hub
    links = stars + list(zip(ids[600:], ids[601:]))
    random.Random(9).shuffle(links)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups({x for e in links for x in e}, links)
    assert names.count("parents") <= 6

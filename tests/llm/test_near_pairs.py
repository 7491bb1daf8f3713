"""Pairs of long texts that are alike but not linked, in the search for near copies."""

import random

from chronovox.llm import jaccard


def test_alike_but_not_linked_are_seldom_compared(spark, monkeypatch):
    """Two families of long texts with a similarity of about 0.71: the marks tell nearly all pairs apart, and the links are those of
    brute force."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(604)]
    other = [f"v{i}" if i % 30 == 7 else w for i, w in enumerate(base)]
    texts = []
    for family in (base, other):
        for k in range(15):
            own = list(family)
            own[rng.randrange(10, 590)] = f"own{k}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    compared, plain = [], jaccard._links

    def counted(pairs, nodes, percent):
        compared.append(pairs.count())
        return plain(pairs, nodes, percent)

    monkeypatch.setattr(jaccard, "_links", counted)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, 5, 80).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = {(i, j) for i in range(30) for j in range(30) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(i, j) for i in got for j in got if got[i] == got[j]} == linked and len(linked) == 450
    assert compared[1] < 45  # of 225 pairs across

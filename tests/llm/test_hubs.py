"""N-gram joins where many sets share n-grams and are not alike."""

import random

import pytest

from isotherm.llm import jaccard, trie


def notices(n):
    """Eight shingles each, six of which all share: 6 of 10, so nothing links."""
    return [(k, f"a{k} b{k} the same ten words stand in all of these notices") for k in range(n)]


def brute_force(rows):
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    groups = trie.Groups(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                groups.join(i, j)
    return {rows[i][0]: groups.find(i) for i in range(len(rows))}


@pytest.fixture
def shipped(monkeypatch):
    """Rows that each screening is given."""
    out = []
    screened = jaccard.screened

    def counted(groups, bits):
        out.append(groups.count())
        return screened(groups, bits)

    monkeypatch.setattr(jaccard, "screened", counted)
    return out


def test_a_hub_of_unlike_sets_is_shipped_in_proportion(spark, shipped):
    for n in (1000, 4000):
        out = jaccard.similar(spark.createDataFrame(notices(n), "doc_id long, text string"))
        assert out.where("component_id <> doc_id or n_shingles <> 8").isEmpty()
    assert max(shipped[:2]) <= 2 * 1000 and max(shipped[2:]) <= 2 * 4000


@pytest.mark.parametrize("block", [256, 4])
def test_hubs_are_brute_force(spark, monkeypatch, block):
    """Notices, copies of some with a word changed at one of their ends, and texts of sentences from one pool."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rnd = random.Random(7)
    rows = notices(60)
    rows += [(100 + k, rows[k][1] + " now" * rnd.randrange(3)) for k in range(0, 60, 3)]
    pool = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(12)]
    for k in range(200, 290):
        rows.append((k, " ".join(rnd.sample(pool, rnd.randrange(5, 9)))))
    for k in range(300, 360):
        w = rnd.choice(rows[80:])[1].split()
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(3)}"
        rows.append((k, " ".join(w[rnd.randrange(3) :])))
    want = brute_force(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for k, g in want.items():
        least[g] = min(k, least.get(g, k))
    assert len(set(want.values())) < len(rows)
    assert got == {k: least[g] for k, g in want.items()}

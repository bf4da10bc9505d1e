"""Near copies against brute-force components over all pairs."""

import random

from clipgraph.llm import simhash


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def smallest_of_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(k for k in sets if root(k) == k)


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n)]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect())


def test_copies_of_a_hub_with_the_largest_key(spark):
    rng = random.Random(11)
    rows = []
    for family in range(6):
        base = words(rng, 300)
        for copy in range(8):  # each has its own edits: alike to the base, not to each other
            own = list(base)
            for at in range(copy * 4, 300, 50):
                own[at] = words(rng, 1)[0]
            rows.append((family * 100 + copy, " ".join(own)))
        rows.append((family * 100 + 99, " ".join(base)))
    want = smallest_of_components(rows)
    assert want == [0, 100, 200, 300, 400, 500]
    assert len(smallest_of_components([r for r in rows if r[0] % 100 != 99])) == 48
    assert kept(spark, rows) == want


def test_copies_with_an_added_passage(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        base = words(rng, 100)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + words(rng, 20)))]
    assert kept(spark, rows) == smallest_of_components(rows) == list(range(0, 120, 2))

"""Events out of order are found with one sort, and whole documents check their events once."""

import random

import pytest

from clipgraph.operators import ordering, validate


@pytest.mark.parametrize("small", [True, False])
def test_order_of_events(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "_small", lambda df: small)
    rng = random.Random(5)
    rows = [(clip, rng.choice([None, 0, 1, 2]) if clip % 2 else seq // 2, seq) for clip in range(40) for seq in rng.sample(range(99), clip // 4)]
    rows += [(100, 1, None), (100, 2, 3), (101, 2, None), (101, 1, 3), (102, None, 1), (102, 0, 2), (None, 3, 1), (None, 2, 2)]
    events = spark.createDataFrame(rows, "clip int, frame int, pos int")
    first = lambda x: (x is not None, x or 0)
    places, moved = {}, set()
    for clip in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == clip]
        byframe = sorted(mine, key=lambda r: (first(r[1]), first(r[2])))
        places |= {r: i for i, r in enumerate(byframe)}
        if byframe != sorted(mine, key=lambda r: first(r[2])):
            moved.add(clip)
    got = {(r["clip"], r["frame"], r["pos"]): (r["sorted_pos"], r["resorted"]) for r in validate.order_events(events, "clip", "frame", "pos").collect()}
    assert got == {r: (i, r[0] in moved) for r, i in places.items()} and 101 in moved and 100 not in moved
    assert sorted(r[0] for r in validate.clips_out_of_order(events, "clip", "frame", "pos").collect()) == sorted(moved)


def test_one_sort_shows_the_order(spark):
    events = spark.range(100).selectExpr("id % 7 as clip", "id % 5 as frame", "id as pos")

    def sorts(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")

    # order_events reads its places twice, for the events and for their clips
    assert sorts(validate.order_events(events, "clip", "frame", "pos")) == 2
    assert sorts(validate.clips_out_of_order(events, "clip", "frame", "pos")) == 1


def test_documents_check_their_events_once(spark, monkeypatch):
    from clipgraph.plans import catalog, q_sources
    from clipgraph.plans.registry import run

    catalog.load()
    settled = []
    monkeypatch.setattr(q_sources, "settle", lambda df: settled.append(df.columns) or df, raising=False)
    assert run("annotation_docs", spark, "/root/testdata/sf0.001").count() > 0
    assert settled == [["clip_id", "frame", "event_seq", "keep", "n_warnings"]]

"""Pooling moves token vectors, not their products."""

from clipgraph.operators import attention


def test_vectors_move_once_to_their_group(spark):
    attn = spark.createDataFrame([(1, s, 0, v, 0.25 * (s + 1)) for s in range(2) for v in range(4)], "sample_id int, slot int, t int, vec_id int, w double")
    tokens = spark.createDataFrame([(v, [float(v), 1.0]) for v in range(4)], "vec_id int, e array<float>")
    out = attention.weighted_pooling(attn, tokens, ["vec_id"], "e", 2, ["sample_id", "slot", "t"])
    got = {r.slot: [round(x, 6) for x in r.pooled] for r in out.collect()}
    assert got == {0: [1.5, 1.0], 1: [1.5, 1.0]}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    above = plan[: plan.index("Join")]
    assert above.count("Exchange hashpartitioning") == 1 and "_b#" not in above.split("Exchange hashpartitioning")[1].split("\n")[0]

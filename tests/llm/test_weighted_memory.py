"""Memory of fingerprints."""

import tracemalloc

from clipgraph.llm.weighted import Draws, fingerprint_batch


def test_words_of_a_batch_are_not_held_together():
    draws = Draws()
    texts = [" ".join(f"w{(d * 7 + k) % 5000}" for k in range(300)) for d in range(4000)]
    fingerprint_batch(texts[:64], draws)
    tracemalloc.start()
    try:
        got = fingerprint_batch(texts, draws)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 << 20
    assert (got[:3] == fingerprint_batch(texts[:3], Draws())).all()

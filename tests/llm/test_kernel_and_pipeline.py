"""The string kernel against explicit subsequences, and the pipeline's stages against brute force on a small corpus."""

import itertools
import random

import numpy as np

import corpus_pipeline
from clipgraph.llm import toxicity


def explicit(kernel, word, decay=0.6, span=toxicity.SPAN):
    """Weights of the letter triples of a word by their letters, of length 1."""
    letters = [1, *[kernel.code.get(c, 0) for c in word], 1]
    out = {}
    for i, j, k in itertools.combinations(range(len(letters)), 3):
        if k - i < span:
            key = (letters[i], letters[j], letters[k])
            out[key] = out.get(key, 0.0) + decay ** (k - i + 1)
    size = sum(v * v for v in out.values()) ** 0.5
    return {key: v / size for key, v in out.items()}


def test_kernel_against_explicit_subsequences():
    kernel = toxicity.Kernel("abcdefgh", 0.6)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghxyz", k=rng.randrange(3, 17))) for _ in range(60)] + ["aaa", "aaaaaaaa", "abababab"]
    marks = words[::3]
    used, rows = kernel.spread(marks)
    got = kernel.against(words, used, rows)
    maps = {w: explicit(kernel, w) for w in words}
    want = [[sum(v * maps[m].get(key, 0.0) for key, v in maps[w].items()) for m in marks] for w in words]
    assert np.allclose(got, want, atol=1e-5)
    # landmarks keep the kernel among themselves
    gram = (rows @ rows.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-9
    features = kernel.against(marks, used, rows) @ (vectors[:, keep] / np.sqrt(values[keep]))
    assert np.allclose(features @ features.T, gram, atol=1e-3)


def word(rng):
    return "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def corpus(rng):
    """(id, text, source, toxic, contaminated) rows: insults, copies, near copies, benchmark passages, a rare source."""
    words = [word(rng) for _ in range(400)]
    insults = ["zzworm", "zzcrook", "zzfool"]
    item = [word(rng) for _ in range(14)]
    rows = []
    for k in range(160):
        text = rng.choices(words, k=rng.randrange(40, 90))
        toxic, contaminated = k % 8 == 1, k % 8 == 3
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        if contaminated:
            at, cut = rng.randrange(len(text)), rng.randrange(len(item) - 9)
            text[at:at] = item[cut : cut + 10]
        rows.append([text, "small" if k % 10 == 5 else "large", toxic, contaminated])
        if k % 16 == 0:  # copies and near copies, one word changed
            near = [*text]
            near[len(near) // 2] = "changed"
            rows += [[text, "large", toxic, contaminated], [near, "large", toxic, contaminated]]
    rng.shuffle(rows)
    return [(i, " ".join(t), s, x, c) for i, (t, s, x, c) in enumerate(rows)], item


def near_kept(rows):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.split()) for k, t in rows)}
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {k for k in sets if top(k) == k}


def test_stages_against_brute_force(spark, tmp_path):
    rows, item = corpus(random.Random(3))
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(x)) for i, _, _, x, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
        kept[name] = [tuple(r) for r in docs.select("doc_id", "source", *(["shard", "slot"] if at == 4 else [])).collect()]
    ids = {name: sorted(r[0] for r in found) for name, found in kept.items()}
    text, source = {i: t for i, t, *_ in rows}, {i: s for i, _, s, *_ in rows}
    want = [i for i, _, _, x, _ in rows if not x]
    assert ids["toxicity"] == want
    want = sorted(near_kept([(i, text[i]) for i in want]))
    assert ids["near_dedup"] == want
    windows = {tuple(item[i : i + 10]) for i in range(5)}
    hit = {i for i in want if windows & {tuple(w[k : k + 10]) for w in [text[i].split()] for k in range(len(w) - 9)}}
    assert hit == {i for i in want if rows[i][4]}
    want = [i for i in want if i not in hit]
    assert ids["decontamination"] == want
    # the small source comes up to twice, the large one once
    times = {i: ids["mixing"].count(i) for i in want}
    assert set(ids["mixing"]) == set(want) and all(n == 1 for i, n in times.items() if source[i] == "large")
    assert all(1 <= n <= 2 for n in times.values()) and any(n == 2 for i, n in times.items() if source[i] == "small")
    assert ids["sharding"] == ids["mixing"]
    slots = {}
    for i, _, shard, slot in kept["sharding"]:
        assert shard == jump(i, 24)
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

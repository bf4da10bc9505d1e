"""Operators against brute force, held-out labels and their own laws."""

import collections
import random
import re
import time

import numpy as np
import pytest
import xxhash

from clipgraph.llm import components, decontaminate, langid, mixing, pages, pii, sharding, simhash, tokencount, toxicity, weighted
from clipgraph.llm.queries import ORACLES, QUERIES, VOCABULARY
from compare import differences

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert differences(name, spark, SMALL) == ""


def texts(spark, folder=SMALL):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


# sharding

def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [random.Random(1).getrandbits(63) for _ in range(300)]
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    for n in (1, 2, 24, 100):
        got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign_shards(df, shards=n).collect()}
        assert all(got[k] == (jump(k, n), jump(k, n + 1)) for k in keys)
        assert all(g in (s, n) for s, g in got.values())


def test_slots_have_no_gaps(spark):
    df = spark.range(20_000).selectExpr("id % 9000 as doc_id", "cast(id as string) as text")
    for r in sharding.assign_shards(df, shards=7).groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
        assert r["max(slot)"] + 1 == r["count(1)"]


# token counts

def test_greedy_pieces(spark):
    pieces = tokencount.read_ranks(VOCABULARY)
    known, longest = set(pieces), max(map(len, pieces))

    def brute(w):
        n = 0
        while w:
            k = min(longest, len(w))
            while w[:k] not in known:
                k -= 1
            w, n = w[k:], n + 1
        return n

    rng = random.Random(2)
    words = [bytes(rng.choices(range(256), k=rng.randrange(40))) for _ in range(3000)] + [b"a" * 999, b""]
    assert tokencount.Automaton(pieces).count(words).tolist() == [brute(w) for w in words]
    got = {r["doc_id"]: r for r in tokencount.count_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), VOCABULARY).collect()}
    for key, text in texts(spark):
        counts = [brute(b" " + w) for w in text.encode().split()]
        assert (got[key]["n_words"], got[key]["n_tokens"], got[key]["longest"]) == (len(counts), sum(counts), max(counts))


def test_long_words():
    machine = tokencount.Automaton(tokencount.read_ranks(VOCABULARY))
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdeth ", k=n)) for n in (1000, 1024, 1025, 3000)]
    apart = [machine._walk(w) for w in words]
    assert machine.count([*words, b"a"]).tolist()[:4] == apart
    small = [bytes(rng.choices(range(256), k=rng.randrange(40))) for _ in range(500)]
    assert machine.count(small).tolist() == [machine._walk(w) for w in small]
    began = time.time()
    known = {}
    out = tokencount.count_batch(["x" * 1_000_000 + " " + "ab" * 700_000], machine, known)
    assert time.time() - began < 10 and out["n_words"][0] == 2 and known == {}


def test_vocabulary_without_bytes_is_refused():
    with pytest.raises(ValueError):
        tokencount.Automaton([b"a", b"ab"])


# near fingerprints

def test_fingerprint_by_definition():
    text = "Ab Cd éF\tgh ab cd Éf gh ij"
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("one two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)


def groups_by_brute_force(fps, bits):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= bits) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("node_rows", [simhash.NODE_ROWS, 40])
def test_near_groups(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)  # small: large nodes are cut into parts
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(5)]
    fps += [base[0] ^ (rng.getrandbits(12)) for _ in range(300)] + [0, 0, 15, 255]
    fps = [f & (2**64 - 1) for f in fps]
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = simhash.stored(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, 4).collect()}
    assert [got[i] for i in range(len(fps))] == groups_by_brute_force(np.array(fps, np.uint64), 4)


def test_gray_index_finds_all():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:200] ^ np.uint64(5), rng.integers(0, 2**63, 333, dtype=np.uint64)])
    x, y = simhash.GrayIndex(a).near(simhash.GrayIndex(b), 4)
    want = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_components(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400))


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_go_and_others_stay(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet").orderBy("doc_id").limit(500)
    rows = {r["doc_id"]: shingles(r["text"]) for r in df.collect()}
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect())
    alike = lambda a, b: len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b])
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if alike(a, b)]
    for gone in set(rows) - set(kept):
        assert any(alike(gone, other) for other in rows if other != gone)


# fingerprints by weighted sampling

def test_likeness_is_generalised_jaccard(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_fingerprints"](spark, MEDIUM).collect()}
    docs = sorted(texts(spark, MEDIUM), reverse=True)
    count = lambda t: collections.Counter(t.encode().lower().split())

    def jaccard(a, b):
        a, b = count(a), count(b)
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    errors = []
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        errors += [got[key]["near_edited"] - jaccard(text, edited), got[key]["near_next"] - jaccard(text, after)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08


def test_order_of_words_does_not_matter():
    draws = weighted.Draws()
    a, b = weighted.fingerprint_batch(["b a c a", "a c a b"], draws)
    assert (a == b).all() and (a > 0).all()


# mixing

def test_mixing_budgets(spark):
    rows = [(i, "w " * 10, "big" if i < 600 else f"s{i % 4}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, entropy=1.0, repetition=3.0)
    tokens = {r["source"]: r["sum(tokens)"] for r in out.groupBy("source").agg({"tokens": "sum"}).collect()}
    assert tokens["big"] == 6000 and all(2990 <= tokens[f"s{k}"] <= 3000 for k in range(4))
    limited = mixing.mix(df, entropy=1.0, repetition=1.0)
    assert limited.count() == 1000
    fixed = mixing.mix(df, entropy=0.0, repetition=4.0, total=5000)
    assert 4900 <= fixed.agg({"tokens": "sum"}).first()[0] <= 5000
    for r in out.groupBy("block").pivot("source").sum("tokens").collect():  # each block holds the mixture
        assert r["big"] is not None and r["s0"] is not None


# decontamination: the shuffled way for large benchmarks gives the same

def test_large_benchmark_way(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(map(str, decontaminate.contamination(docs, items).drop("text").collect()))
    want = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_explode_and_join_are_one_loop(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.occurrences(docs, ["doc_id"], "text", decontaminate.item_windows(items, "item_id", "text", 10))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "BroadcastHashJoin" in plan


# personal data

def base_spans(text):
    out = [(0, "email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, "ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group(0).split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group(0))
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, "card", m))
    out += [(3, "phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group(0))) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for _, k, m in sorted(out, key=lambda x: (x[0], x[2].start()))]


def test_base_spans(spark):
    odd = ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "001.0002.3.4 256.1.1.1", "1" * 5000, "é\U0001f600 x@y.z +1(2)3.4-5678 9", "4111 1111-1111 1111",
           "a" * 5000 + "@b", "1 2 " * 3000, "+1 +1234567890123456 +123 4567 8", "1.2.3", "@@..", "x@-.-"]
    rows = texts(spark, MEDIUM) + [(10**6 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.personal_data(df).collect()}
    for key, text in rows:
        assert set(base_spans(text)) <= got[key], key


def test_added_spans_and_redaction(spark):
    rows = [(i, f"tel +1 (9{i % 90 + 10}) 555-{1000 + i} mail x{i}.y@mail{i % 9}.example.com from {i % 250}.4.5.{i % 99} no.") for i in range(300)]
    rows += [(1000 + i, f"mail me [at] mail{i}.example.com now") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.personal_data(df).filter("doc_id >= 1000").join(df, "doc_id")
    for r in out.select("n_added", "n_email", pii.redact(pii.F.col("text"), pii.F.col("spans")).alias("safe")).collect():
        assert r["n_email"] == 0 and r["n_added"] == 1 and r["safe"] == "mail [email] now"


# pages

def test_excluded_inline_elements_and_wrappers():
    story = " ".join(["the story of the day was told in a long way and it was for all of us"] * 4)
    cases = {
        f"<article><p>{story} <button>Subscribe</button> and then {story}</p></article>": f"{story} and then {story}",
        f"<article><p>{story}</p><span class='ad'>Buy <b>pills</b></span><p>{story}</p><button>Go</button></article>": f"{story}\n{story}",
        f"<article><p>{story} <label>Name</label> {story}</p></article>": f"{story} {story}",
        f"<div class='content with-sidebar'><article><p>{story}</p></article></div>": story,
        f"<div class='site has-header no-ads'><div class='post-body ad-free'><article><p>{story}</p></article></div></div>": story,
        f"<div class='related'><article><p>{story}</p></article></div>": "",
        f"<div class='main-sidebar'><p>{story}</p></div>": "",
        f"<article><p>{story}</p><span class='ad'>never closed</article><p>{story}": story,
    }
    for html, text in cases.items():
        assert pages.main_text(html)[0] == text, html


def test_blocks_of_a_page():
    html = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><p>Site</p></header>
    <nav><ul><li><a href=x>Home</a></li></ul></nav><article class="post"><header><h1>A &amp; B</h1></header><p>One<b>two</b>
     three&nbsp;four <a href="a>b">link</a> and more.<br>Next <p>Short<div class="share-box">Share</div><aside>Aside</aside>
    <section id="comments"><p>Nice</p></section></article><div class="cookie-banner"><p>We use cookies</p></div><footer>&copy; x</footer>"""
    assert pages.main_text(html)[0] == "A & B\nOnetwo three four link and more. Next\nShort"
    assert pages.main_text(None)[0] == pages.main_text("")[0] == pages.main_text("<!-- <p>a</p>")[0] == ""


def test_rules_without_an_article():
    body = "The cat sat on the mat and it was a very good thing for all of the people who were there on that day in the town. "
    html = f"<div><a href=a>Home</a> <a href=b>News</a></div><h2>Title</h2><p>{body * 3}</p><p>Short one</p><p>{body * 3}</p><p>© x</p><p>tail <a href=q>go</a></p>"
    kept = pages.main_text(html)[0].split("\n")
    assert kept[0] == "Title" and kept[2] == "Short one" and len(kept) == 4


def test_pages_of_the_tables(spark):
    import html as h

    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    for r in QUERIES["op9_html_extraction"](spark, MEDIUM).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", raw[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>|</?(?:p|h1)?$", inside.group(1) if inside else "")
        want = [" ".join(h.unescape(re.sub(r"</?b>|<[^>]*$", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r["text"] == "\n".join(w for w in want if w)


# learned operators, on rows that they have not learned from

def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = QUERIES["op5_language"](spark, MEDIUM).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_spans_of_mixed_texts(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = langid.learn(docs, "text", "lang")
    first = {r["lang"]: r["text"][:200] for r in docs.filter("length(text) > 400").orderBy("doc_id").collect()}
    lang, _, spans = model.label(first["de"] + " " + first["en"], {}, 8.0)
    assert [s.split(":")[0] for s in spans.split(",")] == ["de", "en"] and lang in ("de", "en")
    a, b = spans.split(",")[0].split(":")[1:], spans.split(",")[1].split(":")[1:]
    assert a[0] == "0" and a[1] == b[0] and abs(int(b[0]) - 201) < 40


def test_viterbi_against_all_paths():
    model = langid.Model([(x, "word", x, 1) for x in "abc"] + [(x, "script", "Latin", 9) for x in "abc"])
    rng = random.Random(5)
    from itertools import product

    for _ in range(60):
        scored = []
        for _ in range(6):
            s = [-rng.random() * 4 for _ in range(3)]
            best = max(range(3), key=s.__getitem__)
            scored.append((best, tuple(v - s[best] for v in s)))
        spans = model.path(scored, 2.0)
        ends = [s[0] for s in spans[1:]] + [6]
        path = [k for (a, k), b in zip(spans, ends, strict=True) for _ in range(a, b)]
        value = lambda p: sum(scored[t][1][k] for t, k in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(value(path) - max(map(value, product(range(3), repeat=6)))) < 1e-9


def test_toxicity_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.learn(docs, labels.filter(~langid.held_out(labels["doc_id"])))
    got = toxicity.score(docs.filter(langid.held_out(docs["doc_id"])), model).join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n.get((1, 1), 0) >= 0.75 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * (n.get((0, 0), 0) + n.get((0, 1), 0))
    for word in ("i.d.i.o.t", "i d i o t", "sc*um"):  # letters in between
        assert model.score([f"you {word} there"], {})[0][0] >= 0.7, word


# pipeline

def test_pipeline(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, MEDIUM).collect()
    kept = {r["doc_id"] for r in out}
    assert 0.7 * len(docs) < len(kept) <= len(docs) and all(r["text"] == docs[r["doc_id"]]["text"] for r in out)
    assert len({r["text"] for r in out}) == len(kept)  # no two documents with one text
    assert max(collections.Counter(r["doc_id"] for r in out).values()) <= 2
    assert all(r["shard"] == jump(r["doc_id"], 24) for r in out)
    dirty = {r["doc_id"] for r in QUERIES["op10_decontamination"](spark, MEDIUM).filter("contaminated").collect()}
    assert not kept & dirty

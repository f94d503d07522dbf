"""Vectors against brute force; classifiers by held-out accuracy; the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sedge.llm import quality, toxicity
from sedge.llm.common import Scratch
from sedge.llm.embedding_dedup import link_vectors
from sedge.llm.graph import components
from sedge.llm.quality import keep_good, score_quality
from sedge.llm.supervised import hash_of, held_out, labelled_sample
from sedge.llm.toxicity import score_toxicity


def vectors(seed=1, labels=4, clusters=30, hot=150, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(labels):
        for c in range(clusters):
            base = r.standard_normal(dim)
            for _ in range(hot if c == 0 and g == 0 else r.integers(1, 5)):
                x = base + r.standard_normal(dim) * r.choice([0.02, 0.1, 0.2])
                rows.append((x * r.uniform(0.1, 9), g))
    return [(i * 3 + 1, x.astype(np.float32).tolist(), g) for i, (x, g) in enumerate(rows)]


def brute_links(rows, threshold=0.93):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = np.array([r[2] for r in rows])
    m = (x @ x.T >= threshold) & (g[:, None] == g)
    np.fill_diagonal(m, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(m, comp[None], ids.max() + 1).min(axis=1))
        if (new == comp).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, m.sum(axis=1), comp, strict=True)}
        comp = new


@pytest.mark.parametrize("window, passes, recall", [(1024, 12, 1.0), (32, 16, 0.97)])
def test_links_against_brute_force(spark, window, passes, recall):
    """With labels within a window all links are found; with a small window most, and never a wrong or doubled one."""
    rows = vectors(hot=20 if window == 32 else 150)
    got = {r["vec_id"]: r for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), window=window, passes=passes).collect()}
    want = brute_links(rows)
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(got[i]["n_links"] for i in want) >= recall * sum(n for n, _ in want.values())
    if recall == 1:
        assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_links_beyond_a_window(spark):
    """Groups of copies and near copies far larger than a window, scaled copies and repeated ids count all their links."""
    r = np.random.default_rng(7)
    base, other, third = r.standard_normal((3, 16))
    rows = [(n, base.tolist(), 0) for n in range(300)] + [(1000 + n, (other + 0.1 * r.standard_normal(16)).tolist(), 0) for n in range(200)]
    rows += [(2000 + n, (third * (n + 1)).tolist(), 0) for n in range(150)] + [(3000, (base + 0.02 * r.standard_normal(16)).tolist(), 0)]
    rows = [(i, x, g) for i, x, g in rows] + [(5000 + n, x, 1) for n, x in enumerate(r.standard_normal((20, 16)).tolist())]
    schema = "vec_id long, embedding array<double>, label int"
    want = brute_links(rows)
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in link_vectors(spark.createDataFrame(rows, schema), window=32).collect()}
    assert got == want and want[0][0] >= 300 and want[1000][0] > 65
    twice = [(7, base.tolist(), 0)] * 3 + [(7, (base + 0.01).tolist(), 0)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in link_vectors(spark.createDataFrame(rows[:5] + [(8, base.tolist(), 0)] + [x for x in twice], schema), window=32).collect()}
    assert got[8] == (9, 0) and got[7] == (24, 0)


def test_odd_vectors(spark):
    nan, inf, one = float("nan"), float("inf"), [1.0, 2.0]
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, nan], 1), (9, [inf, 1.0], 1), (10, [1.0, 2.0, 0.0], 1), (11, [], 1), (None, one, 1), (2, one, 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, key string, rank int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in link_vectors(df).collect())
    assert got == [(-1, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), *((i, 0, i) for i in range(3, 12))]
    assert link_vectors(df.where("false")).count() == 0


def test_vectors_of_any_size(spark):
    """Components whose squares would over- or underflow are finite, and compared."""
    rows = [(1, [1.0, 2.0], 1), (2, [1e200, 2e200], 1), (3, [1e-200, 2e-200], 1), (4, [-1e300, 1e300], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_recall_beyond_a_window(spark):
    """Production parameters on a label six windows large, with pairs planted just above the threshold."""
    r = np.random.default_rng(11)
    x = r.standard_normal((6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((400, 24))
    z -= (z * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    t = r.uniform(0.931, 0.95, (400, 1))
    y = t * x[:400] + np.sqrt(1 - t * t) * z / np.linalg.norm(z, axis=1, keepdims=True)
    every = np.concatenate([x, y]).astype(np.float32)
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = {g["vec_id"]: g["n_links"] for g in link_vectors(spark.createDataFrame([(n, e.tolist(), 3) for n, e in enumerate(every)], "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[n] <= links[n] for n in got) and sum(got.values()) >= 0.99 * links.sum() >= 700


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(n, n + 1) for n in range(1000, 1060)] + [(5000, n) for n in range(5001, 5200)] + [(7, 7), (None, 3)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {x["node"]: x["component"] for x in got} == {n: find(n) for n in root} and len(got) == len(root)


def corpus(n=400, seed=2):
    """Prose in two languages, junk of several kinds, and insults."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "ti", "ou", "st", "ha", "en", "ly"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(["en", "de"])
        w = [word() for _ in range(r.randint(5, 300))]
        good, toxic = r.random() < 0.7, r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["moron", "scum"]) if lang == "en" else "lowei" + r.choice(["en", "st", "ung", "keit"]))
        if not good:
            kind = r.randrange(3)
            w = [x + "!!" for x in map(str.upper, w)] if kind == 0 else [x + r.choice(["***", "$$$"]) for x in w] if kind == 1 else [x for x in w for _ in range(6)]
        docs.append((i, " ".join(w), lang, "s", 1.5, 3))
        if i % 5:
            labels.append((i, int(good), int(toxic)))
    docs += [(9000, None, "en", None, 0.0, 1), (9001, "", None, "s", 0.0, 1), (None, "text", "xx", "s", 0.0, 1), (1, docs[1][1], "en", "s", 0.0, 1)]
    return docs, [*labels, (9000, 1, 0), (9001, None, None), (None, 1, 1), (77, 5, 5)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double, predicted int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("label, score", [("quality", score_quality), ("toxic", score_toxicity)])
def test_held_out_accuracy(spark, tables, label, score):
    docs, labels = tables
    rows = score(docs, labels).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r[label] in (0, 1)}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    again = {(r["doc_id"], r["score"]) for r in score(docs.repartition(5), labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in rows}
    assert score(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in score(docs, labels.where("false")).collect()} != set()


def test_no_model_sees_the_held_out_fold(spark, tables):
    docs, labels = tables
    used = {r[0] for r in labelled_sample(docs, labels, "quality")}
    out = {r["doc_id"] for r in docs.where(held_out(docs["doc_id"])).collect()}
    assert used and out and not used & out
    assert len(labelled_sample(docs, labels, "quality", rows=20)) <= 40
    assert sum(len(r[1]) for r in labelled_sample(docs, labels, "quality", chars=5000)) <= 5000


def test_a_long_text_does_not_empty_the_sample(spark):
    ids = [i for i in range(60) if not zlib.crc32(str(i).encode()) % 5 == 0]
    first = min(ids, key=lambda i: (hash_of(i), i))
    docs = spark.createDataFrame([(i, "x" * (100_000 if i == first else 10)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == first % 10)) for i in ids], "doc_id long, quality int")
    used = labelled_sample(docs, labels, "quality", chars=10_000)
    assert {r[0] for r in used} == set(ids) - {first} and {r[2] for r in used} == {0, 1}
    used = labelled_sample(docs, labels, "quality", chars=60)
    assert sorted(r[2] for r in used) == [0, 0, 0, 1, 1, 1]


def test_sample_of_repeated_ids(spark):
    """Of documents that repeat an id the least text is used, whatever the order; ids with both labels are not."""
    rows = [(1, "b"), (1, "a"), (2, "c"), (3, "d"), (4, None), (4, "x")]
    used = []
    for turn in (1, -1):
        docs = spark.createDataFrame(rows[::turn], "doc_id long, text string")
        labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (3, 1), (4, 1)][::turn], "doc_id long, quality int")
        used.append([r[:3] for r in labelled_sample(docs, labels, "quality") if r[0] != 2])
        assert all(r[0] != 2 for r in labelled_sample(docs, labels, "quality"))
    assert used[0] == used[1] and set(used[0]) <= {(1, "a", 0), (3, "d", 1), (4, "", 1)}


def test_attention_gradients():
    x, owner = quality.passages(["an er " * 90 + "TH!! on$$$", "a a a a", ""])
    model = quality.Attention.new(1)
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.forward(x, owner)["y"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + 0.5e-5 * (model.p["W"] ** 2).sum() + 0.5e-4 * (model.p["o"] ** 2).sum()

    grads, rng = model.gradients(x, owner, y, w), np.random.default_rng(0)
    for name, p in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old, h = p[at], 1e-5
            p[at] = old + h
            up = loss()
            p[at] = old - h
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-6


def test_long_texts_pool_in_pieces():
    model = toxicity.train([(n, r[1] or "", r[2], "en") for n, r in enumerate([(0, "good words here", 0), (1, "bad moron here", 1)] * 20)])
    long = "fine words " * 60_000
    assert model.score([long])[0] < 0.5 < model.score([long + "moron " + long])[0]
    assert quality.Attention.new(1).score([long]).shape == (1,)


def test_pipeline(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python where there is a rule for it."""
    docs, labels = corpus(300, seed=6)
    docs = [d for d in docs if d[0] is not None and d[0] < 9000][:300]
    copies = [(1000 + n, docs[n][1] + " end", *docs[n][2:]) for n in range(0, 60) if len(docs[n][1].split()) > 60]
    leak = " ".join(f"leak{n}" for n in range(30))
    leaky = [(2000, docs[0][1] + "\n" + leak, *docs[0][2:])]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, score double, predicted int"
    spark.createDataFrame(docs + copies + leaky, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/out{n}")
        now = spark.read.parquet(f"{folder}/out{n}")
        seen.append(now.collect())
        assert n == 4 or now.columns == schema.replace(",", "").split()[::2]
    truth = {r[0]: r[1] for r in labels if r[0] is not None and r[1] in (0, 1)}
    kept = {r["doc_id"] for r in seen[0]}
    assert sum((i in kept) == bool(q) for i, q in truth.items() if i < 300) > 0.95 * sum(i < 300 for i in truth)
    twins = {c[0]: c[0] - 1000 for c in copies}
    after = {r["doc_id"] for r in seen[1]}
    assert all(not (c in after and o in after) for c, o in twins.items() if o in kept) and {i for i in kept if i < 300} - after == set()
    assert 2000 not in {r["doc_id"] for r in seen[2]} and {r["doc_id"] for r in seen[2]} == after - {2000}
    assert {r["doc_id"] for r in seen[3]} <= {r["doc_id"] for r in seen[2]}
    assert len(seen[4]) == len(seen[3])
    ends = sorted((r["start"], r["n_tokens"]) for r in seen[4])
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert keep_good(now.sparkSession.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).count() == len(seen[0])
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen[4]))


def test_stages_begin_with_collected_executors(spark, tmp_path):
    """A heap that the stages before have grown shrinks before a stage's workers come on top, and again before files are read back."""

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.createDataFrame([(n, "some words here", "s") for n in range(20)], "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    for name, least in (("mixing sources to target weights", 1), ("token-ID output", 2)):
        before = collections()
        out = stages[name](spark, docs, str(tmp_path))
        assert collections() >= before + least, name
        assert out.count() > 0

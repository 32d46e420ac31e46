"""Quality network, importance resampling and whitening, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_net, resampling, whitening
from tidemark.llm.common import held_out
from tidemark.llm.queries import QUERIES

# --- importance resampling --------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, runs):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent, least, buckets, runs, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(d, *plain_features(t, runs)) for d, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for x in target for f in plain_features(x, runs)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for d, words, fs in found:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    drawn = drawn[: percent * len(drawn) // 100]
    ranks = Counter((r[:4], i) for i, r in enumerate(drawn, 1))
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return ranks, left


def check_resample(rows, docs, target, percent=10, least=20, buckets=10_000, runs=1):
    ranks, left = plain_resample(docs, target, percent, least, buckets, runs)
    assert Counter((tuple(r[:4]), r.rank) for r in rows if r.rank is not None) == ranks
    assert Counter(tuple(r[:4]) for r in rows if r.rank is None) == left
    assert [r.rank for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)] == list(range(1, sum(ranks.values()) + 1))


def test_resample_query(spark, sf, documents):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = QUERIES["op12_importance_resampling"](spark, sf).collect()
    assert rows[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]
    check_resample(rows, [(d.doc_id, d.text) for d in documents.collect()], target)


@pytest.mark.parametrize("runs,percent,least,buckets", [(1, 50, 1, 10_000), (3, 100, 0, 97), (2, 0, 1, 100_000)])
def test_resample_edges(spark, edge, empty, runs, percent, least, buckets):
    target = ["Größe word line", None, "a b c d"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for docs in (edge, empty):
        rows = resampling.resample(docs, wanted, percent, least, buckets, runs).collect()
        check_resample(rows, [(d.doc_id, d.text) for d in docs.collect()], target, percent, least, buckets, runs)
    rows = resampling.resample(edge, wanted.limit(0), percent, least, buckets, runs).collect()
    check_resample(rows, [(d.doc_id, d.text) for d in edge.collect()], [], percent, least, buckets, runs)


def test_one_id_with_a_third_of_the_rows(spark):
    docs = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same words here").alias("text"))
    rows = resampling.resample(docs, docs, 100, 1).collect()
    check_resample(rows, [(d.doc_id, d.text) for d in docs.collect()], ["same words here"] * 600, 100, 1)


def test_crcs_by_length():
    features = [b"", b"a", b"b", "größe".encode(), b"x" * 511, b"y" * 512, b"z" * 5000, *[str(i).encode() for i in range(2000)]]
    assert resampling.crcs(features).tolist() == [zlib.crc32(f) for f in features]


@pytest.mark.parametrize("runs", [1, 2, 4])
def test_pieces_lose_no_run(monkeypatch, runs):
    text = "One two-three 4our 日本 " * 40 + "x" * 300
    whole = Counter(f.encode() for f in plain_features(text, runs)[1])
    monkeypatch.setattr(resampling, "CHUNK", 7)
    parts = list(resampling.pieces(text.encode(), runs))
    assert len(parts) > 5 and sum((Counter(f) for _, f in parts), Counter()) == whole
    assert sum(n for n, _ in parts) == plain_features(text, runs)[0]


# --- whitening --------------------------------------------------------------------------------------------------------


def check_whitened(rows, vectors, components=32):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    n, x = len(kept), [v for _, v in kept]
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    m = np.array(x, np.float64) - np.array(sums) / n
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(values), int((values > values[0] * 1e-10).sum()))
    w = m @ vectors[:, :k] / np.sqrt(values[:k])
    assert len(rows) == n * k and all(r.n == n for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-6)
        assert 0 <= r.identity_error <= 1e-6
    signs = np.zeros(k)
    for (i, _), d, row in zip(kept, deviation, w, strict=True):
        found = sorted(by_id[i], key=lambda r: r.component)[:k]
        assert [r.component for r in found] == list(range(1, k + 1)) and all(r.deviation == d for r in found)
        got = np.array([r.whitened for r in found])
        signs = np.where((signs == 0) & (np.abs(row) > 1e-3), np.sign(got * row), signs)
        assert np.allclose(got * np.where(signs == 0, 1, signs), row, atol=1e-6)


def test_whitening_query(spark, sf):
    rows = QUERIES["op13_whitening"](spark, sf).collect()
    stored = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check_whitened(rows, [(r.vec_id, r.embedding) for r in stored])


def test_whitening_edges(spark):
    draw = np.random.default_rng(3)
    schema = "vec_id long, embedding array<double>, x int, n string"
    good = [(i, (draw.standard_normal(5) * [9, 4, 2, 1, 0.5]).tolist(), 1, "n") for i in range(300)]
    odd = [(1000, None, 1, None), (1001, [1.0, None, 2.0, 3.0, 4.0], 1, None), (1002, [math.nan] * 5, 1, None), (1003, [math.inf] + [0.0] * 4, 1, None), (1004, [], 1, None)]
    rows = whitening.whiten(spark.createDataFrame(good + odd, schema).repartition(7), components=4).collect()
    check_whitened(rows, [r[:2] for r in good + odd], 4)
    for few in ([], odd, good[:1], good[:1] * 5):
        assert whitening.whiten(spark.createDataFrame(few, schema)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 7.0], 1, None) for i in range(50)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(flat, schema)).collect()} == {1}
    twice = whitening.whiten(spark.createDataFrame(good[:40] + good[:40] + [(None, [1.0] * 5, 1, None)], schema)).collect()
    assert {r.n for r in twice} == {81} and sum(r.vec_id is None for r in twice) == 5
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([*good, (9, [1.0, 2.0], 1, None)], schema))


def test_covariance_is_exact_for_large_numbers(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(c) for c in draw.integers(-(2**45), 2**45, 3)]) for i in range(200)]
    x = whitening.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 64, 1_000_000)
    known = whitening.moments(x)
    whole = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    assert known.sums == [sum(c) for c in zip(*whole, strict=True)]
    found = known.covariance(whitening.squares(x, known))
    for i in range(3):
        for j in range(3):
            centred = sum((200 * v[i] - known.sums[i]) * (200 * v[j] - known.sums[j]) for v in whole)
            assert math.isclose(found[i, j], centred / 200**3, rel_tol=1e-15)


# --- quality network --------------------------------------------------------------------------------------------------


def plain_vectors(texts, seed=11):
    index = quality_net.index_vectors(seed)
    dense = np.zeros((len(index), quality_net.DIM))
    for slot, entries in enumerate(index):
        for e in entries:
            dense[slot, e // 2] += -1 if e % 2 else 1
    out, numbers = np.zeros_like(dense), quality_net.Slots()
    for text in texts:
        slots = numbers.of_text(text)
        for i, own in enumerate(slots):
            for j in range(max(0, i - quality_net.WINDOW), min(len(slots), i + quality_net.WINDOW + 1)):
                if j != i:
                    out[own] += dense[slots[j]]
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.where(length == 0, 1, length)


def test_word_vectors(edge, documents, monkeypatch):
    texts = [r.text for r in edge.collect()]
    assert np.allclose(quality_net.word_vectors(edge), plain_vectors(texts), atol=1e-6)
    contexts = quality_net.Contexts(11)
    monkeypatch.setattr(quality_net, "PAIRS", 64)
    numbers = quality_net.Slots()
    for text in texts:
        contexts.add(numbers.of_text(text))
    contexts.count()
    length = np.sqrt((contexts.sums**2.0).sum(axis=1, keepdims=True))
    assert np.allclose(contexts.sums / np.where(length == 0, 1, length), plain_vectors(texts), atol=1e-6)


def test_pooling_in_parts(monkeypatch):
    draw = np.random.default_rng(1)
    vectors, slots = draw.standard_normal((50, quality_net.DIM)).astype(np.float32), draw.integers(0, 50, 500)
    v = vectors[slots].astype(float)
    plain = np.concatenate([v.mean(axis=0), np.sqrt((np.diff(v, axis=0) ** 2).mean(axis=0))])
    for run in (7, 499, 500, 1000):
        monkeypatch.setattr(quality_net, "RUN", run)
        assert np.allclose(quality_net.pooled(vectors, slots), plain, atol=1e-4)
    assert not quality_net.pooled(vectors, slots[:0]).any()


def test_gradients():
    draw = np.random.default_rng(2)
    x, y = draw.standard_normal((40, 6)), (draw.random(40) < 0.5).astype(float)
    net = quality_net.Network(hidden=4, epochs=1, decay=0.0).fit(x, y)
    z = (x - net.mean) / net.scale
    for i, g in enumerate(net._gradients(z, y)):
        flat, step = net.w[i].reshape(-1), 1e-6
        for j in range(len(flat)):
            before = flat[j]
            flat[j] = before + step
            up = quality_net.log_loss(net.margin(x), y)
            flat[j] = before - step
            down = quality_net.log_loss(net.margin(x), y)
            flat[j] = before
            assert abs((up - down) / (2 * step) - g.reshape(-1)[j]) < 1e-5


def test_temperature_mends_overconfidence():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((4000, 3))
    y = (draw.random(4000) < quality_net.probability(x.sum(axis=1))).astype(float)
    net = quality_net.Network(epochs=8).fit(x[:2000], y[:2000])
    net.w[2] *= 5
    net.w[3] *= 5
    raw = quality_net.log_loss(net.margin(x[2000:]), y[2000:])
    net.calibrate(x[:2000], y[:2000])
    assert net.temperature > 2 and quality_net.log_loss(net.margin(x[2000:]) / net.temperature, y[2000:]) < raw
    p = net.predict(x[2000:])
    assert abs(p.mean() - y[2000:].mean()) < 0.04


def test_quality_query(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op11_quality_classifier"](spark, sf)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    stored = rows.join(labels, "doc_id", "left").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert len(stored) == docs.count()
    fold = {r.doc_id for r in docs.filter(held_out("doc_id")).select("doc_id").collect()}
    assert all(r.held_out == (r.doc_id in fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in stored)
    judged = [r for r in stored if r.held_out and r.quality is not None]
    kept = lambda label: np.mean([r.predicted for r in judged if r.quality == label])
    assert len(judged) > 500 and kept(1) > 0.98 and kept(0) < 0.08


def test_held_out_labels_teach_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_net.fit(documents, marks) for marks in (labels, turned))
    texts = [r.text for r in documents.collect()]
    assert (a.scores(texts, quality_net.Slots()) == b.scores(texts, quality_net.Slots())).all()


def test_quality_edges(spark, edge, empty, no_labels, documents):
    odd = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (3, 7, 0), (None, 1, 0), (4, 1, 0), (4, 1, 0), (10**15, 0, 0), (6, None, 1)], "doc_id long, quality int, toxic int"
    )
    for docs in (edge, empty):
        for labels in (no_labels, odd):
            model = quality_net.fit(docs, labels)
            found = docs.select("doc_id", "score", quality_net.score(model, "text").alias("s")).collect()
            assert len(found) == docs.count() and all(0 <= r.s <= 1 for r in found) and model.network is None
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_net.fit(documents, labels)
    s = {r.doc_id: r.s for r in edge.select("doc_id", quality_net.score(model, "text").alias("s")).collect()}
    assert s[0] == s[1] == s[2] and s[4] == s[5]

"""Sharding, quality rules, language, toxicity, near copies and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, minhash, quality, sharding, toxicity
from tidemark.llm.common import held_out
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size_of(text):
    return len((text or "").encode()) + 8


# --- sharding ---------------------------------------------------------------------------------------------------------


def check_shards(rows, docs, shards, law):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d.doc_id, size_of(d.text), zlib.crc32((d.text or "").encode())) for d in docs
    )
    slots, held = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < shards and r.law == law and r.grown_shard is None
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        counts = [len(slots.get(s, [])) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    elif rows:
        largest = max(r.size for r in rows)
        assert all(abs(held.get(s, 0) - sum(held.values()) / shards) <= largest for s in range(shards))


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(edge, empty, documents, law):
    for docs, shards in ((edge, 3), (documents, 7), (empty, 4)):
        check_shards(sharding.shard(docs, shards, law).collect(), docs.collect(), shards, law)


def test_shards_of_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard(docs, 24).collect()
    check_shards(rows, docs.collect(), 24, "bytes")


def test_overfull_ranges_are_divided(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"),
        F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("tie"),
    )
    placed = sharding.dealt(rows, sharding.splitters(rows, 50)).groupBy("range").count().collect()
    assert max(r["count"] for r in placed) <= 2 * 4000 / 50


def test_shard_query(spark, sf, documents):
    rows = QUERIES["op3_sharding"](spark, sf).collect()
    check_shards(rows, documents.collect(), 24, "bytes")


# --- quality rules ----------------------------------------------------------------------------------------------------


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_text_stats(edge, documents):
    numbers = quality.WordNumbers()
    numbers.limit = 50
    for r in edge.collect() + documents.collect():
        assert quality.text_stats(r.text, numbers) == plain_stats(r.text)


def test_repeated_words_renumbers_large_products():
    words = np.array([1 << 40, 5, 1 << 41, 9, 1 << 40, 5, 1 << 41])
    assert quality.repeated_words(words) == 6


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.3), (20, 20, 0.5), (7, 400, 0.05)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert math.exp(quality.log_binomial_tail(k, n, p)) == pytest.approx(want, rel=1e-9)


def test_certificate_limits_false_rejection():
    """A cutoff whose true false rejection equals the risk is certified at most as often as the level allows."""
    rng, risk, level, n = np.random.default_rng(3), 0.05, 0.1, 400
    wrong = sum(quality.certified([int(rng.binomial(n, risk))], n, risk, level) for _ in range(2000))
    assert wrong / 2000 <= level + 0.02
    assert quality.certified([0, 0, 200, 0], 400, 0.05, 0.05) == 2  # the walk ends at the first failure
    assert quality.pick([3.0, 2.0], [0, 0], [0, 0], 400, 0.05, 0.05, 20) is None


def test_thresholds_find_bad_rows_and_spare_small_strata(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(6000):
        bad = i % 10 == 0
        symbols = int(200 * rng.uniform(0.5, 1.0)) if bad else int(rng.integers(0, 5))
        rows.append(("big" if i % 3 else "b2", (200, 1000, symbols, 10, 0, 0), int(not bad), bool(i % 2)))
    rows += [("small", (200, 1000, 100, 10, 0, 0), 0, bool(i % 2)) for i in range(20)]
    frame = spark.createDataFrame(rows, f"stratum string, stats {quality.STATS_TYPE}, quality int, propose boolean")
    found = {(r.stratum, r.rule): r for r in quality.thresholds(frame).collect()}
    for name in ("big", "b2"):
        assert 0.02 <= found[name, "symbols"].cutoff < 0.5 and found[name, "symbols"].good_rejected == 0
    assert not any(s == "small" for s, _ in found)


def test_rule_on_edge_cases(edge, empty, no_labels):
    rows = quality.rule(edge, no_labels).collect()
    assert len(rows) == edge.count() and set(edge.columns) <= set(rows[0].__fields__)
    for r in rows:
        assert tuple(r._stats) == plain_stats(r.text)
        failed = r._stats.n_words < 50 or 100 * r._stats.n_repeat_words > 50 * r._stats.n_words
        assert r._base_failed == failed and r._kept == (not failed)
    assert quality.rule(empty, no_labels).count() == 0


def test_quality_query(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    for d in documents.collect():
        r, want = got[d.doc_id], plain_stats(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (*want[:3], *want[4:])
        assert r.base_failed == (want[0] < 50 or 100 * want[5] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_verdict_against_a_plain_version(spark):
    """Every cutoff is certified by a plain count and a plain binomial sum, and decides as it says."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    propose = {r.doc_id: r.p for r in docs.select("doc_id", (F.xxhash64(F.lit("propose"), "doc_id") % 2 == 0).alias("p")).collect()}
    found = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    rows = quality.judged(docs, labels, "lang", "doc_id", "text", ["doc_id", "lang"])
    stats = rows.select("row.doc_id", F.col("row.lang").alias("stratum"), "stats")
    marked = stats.join(labels.select("doc_id", "quality"), "doc_id").withColumn("propose", F.xxhash64(F.lit("propose"), "doc_id") % 2 == 0)
    limits = quality.thresholds(marked).collect()
    plain, holdout = {}, defaultdict(list)
    for d in docs.collect():
        s = plain_stats(d.text)
        words, lines = max(s[0], 1), max(s[3], 1)
        failed = s[0] < 50 or 100 * s[5] > 50 * s[0]
        by = {"symbols": s[2] / words, "repeats": s[5] / words, "copied lines": s[4] / lines, "long words": s[1] / words, "short words": -s[1] / words}
        plain[d.doc_id] = (d.lang or "", failed, by)
        if not failed and marks.get(d.doc_id) in (0, 1) and not propose[d.doc_id]:
            holdout[d.lang or ""].append((marks[d.doc_id], by))
    least = next(n for n in range(1, 10_000) if 0.99**n <= 0.05 / (5 * len(holdout)))
    small = {s for s, part in holdout.items() if sum(q for q, _ in part) < least}
    assert {"de", "es", "fr"} <= small and "en" not in small
    pool = [x for s in small for x in holdout[s]]
    assert {r.stratum for r in limits} == set(holdout) and all(r.pooled == (r.stratum in small) for r in limits)
    cutoffs = defaultdict(dict)
    for r in limits:
        part = pool if r.pooled else holdout[r.stratum]
        n = sum(q for q, _ in part)
        k = sum(1 for q, by in part if q and by[r.rule] > r.cutoff)
        assert (r.n_good, r.good_rejected) == (n, k) and r.bad_rejected == sum(1 for q, by in part if not q and by[r.rule] > r.cutoff)
        assert sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) <= 0.05 / (5 * len(holdout)) * (1 + 1e-9)
        cutoffs[r.stratum][r.rule] = r.cutoff
    for doc_id, (stratum, failed, by) in plain.items():
        assert found[doc_id].kept == (not failed and all(by[name] <= c for name, c in cutoffs[stratum].items()))


def test_pooled_strata_are_certified_together(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 9}", (200, 1000, 300 if i % 10 == 0 else int(rng.integers(0, 5)), 10, 0, 0), int(i % 10 > 0), bool(i // 9 % 2)) for i in range(4000)]
    rows += [("lone", (200, 1000, 5, 10, 0, 0), 0, True)]
    frame = spark.createDataFrame(rows, f"stratum string, stats {quality.STATS_TYPE}, quality int, propose boolean")
    found = quality.thresholds(frame).collect()
    assert {r.stratum for r in found if r.rule == "symbols"} == {*(f"s{i}" for i in range(9)), "lone"} and all(r.pooled for r in found)
    assert quality.thresholds(frame.limit(0)).count() == 0


# --- language ---------------------------------------------------------------------------------------------------------


def test_words_come_before_grams():
    grams = {0: {"chat": np.array([9.0, 1.0])}, 1: {c: np.array([1.0, 30.0]) for c in "chatu"}}
    model = langid.Model(["fr", "en"], grams, {s: np.sum(list(g.values()), axis=0) for s, g in grams.items()})
    score = langid.Scorer(model)
    assert score("Chat CHAT")[0] == "fr" and score("hut")[0] == "en"
    assert score("1 2 ²") == (langid.UNKNOWN, 0.0) and score(None) == (langid.UNKNOWN, 0.0)


def test_backoff_uses_the_longest_known_gram():
    grams = {4: {"<abc": np.array([50.0, 1.0])}, 2: {"bc": np.array([1.0, 90.0])}, 1: {"c": np.array([5.0, 5.0])}}
    model = langid.Model(["x", "y"], grams, {s: np.sum(list(g.values()), axis=0) + 100 for s, g in grams.items()})
    want = (model.tables[4]["<abc"] + model.tables[2]["bc"] + model.tables[1]["c"]) / 3
    assert np.allclose(model.word("abc"), want)


def test_language_of_edge_cases(edge, empty):
    model = langid.fit(edge.select(F.col("doc_id").alias("id"), "text", "lang"))
    got = edge.select("text", langid.predict(model, "text").alias("p")).collect()
    for r in got:
        assert 0 <= r.p.score <= 1 and (r.p.lang == "und") == (not r.text or not any(c.isalpha() for c in r.text))
    nothing = langid.fit(empty.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r.l for r in edge.select(langid.predict(nothing, "text")["lang"].alias("l")).collect()} == {"und"}


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in rows} == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97


# --- toxicity ---------------------------------------------------------------------------------------------------------


def test_ftrl_learns_and_stays_sparse():
    share = {}
    for l1 in (0.0, 1.0, 4.0):
        rng = np.random.default_rng(2)
        model = toxicity.FTRL(12, 0.1, 1.0, l1, 1.0)
        for _ in range(3000):
            label = int(rng.random() < 0.3)
            noise = rng.integers(2, 4000, 40)
            model.learn(np.unique(np.concatenate([[0], noise, [4001] if label else []]).astype(np.int64)), label)
        w = model.weights(slice(None))
        assert w[4001] > 3 * np.abs(w[2:4000]).max()
        share[l1] = (w != 0).mean()
    assert share[0.0] > share[1.0] > share[4.0] and share[4.0] < 0.1


def test_bias_parts_the_labels():
    assert toxicity.best_cut(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_cut(np.array([1.0, 1.0, 1.0]), np.array([1, 0, 1])) == 0.0
    assert toxicity.best_cut(np.zeros(0), np.zeros(0)) == 0.0 and toxicity.best_cut(np.array([2.0]), np.array([0])) == 0.0


def test_toxicity_of_edge_cases(edge, empty, no_labels):
    weights = toxicity.fit_labels(edge, no_labels)
    assert {r.s for r in edge.select(toxicity.score(weights, "text").alias("s")).collect()} == {0.5}
    assert empty.select(toxicity.score(weights, "text")).count() == 0


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_toxicity"](spark, sf).collect()
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(a and b for a, b in held)
    assert hit / sum(a for a, _ in held) > 0.8 and hit / sum(b for _, b in held) > 0.9  # from 400 toxic rows
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_is_the_crc_of_the_id(spark):
    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


# --- near copies ------------------------------------------------------------------------------------------------------


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_similarity(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def plain_classes(rows, threshold=0.8):
    bags = {}
    for d, t in rows:
        bags.setdefault(d, bag(t))
    parent = {d: d for d in bags}

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    by = defaultdict(set)
    for d, b in bags.items():
        for s in b:
            by[s].add(d)
    pairs = {(a, b) for m in by.values() for a in m for b in m if a < b}
    for a, b in pairs:
        if find(a) != find(b) and plain_similarity(bags[a], bags[b]) >= threshold:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {d: find(d) for d in bags}


def variants(seed=0, families=12, n=120):
    """Families of near copies with more and more changed words, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        words = [f"w{f}_{i}" for i in rng.integers(0, 400, n)]
        for v in range(8):
            rows.append((len(rows), " ".join(words)))
            for _ in range(2 if f % 2 else 1):
                words[int(rng.integers(0, n))] = f"new{f}_{v}_{rng.integers(0, 99)}"
    return rows


def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = (" ".join(rng.choice(list("abc"), rng.integers(1, 60))) for _ in range(2))
        got = minhash.similarity(minhash.shingles(a), minhash.shingles(b))
        assert got == pytest.approx(plain_similarity(bag(a), bag(b)), abs=1e-9)


def test_signature_estimates_similarity():
    x = np.arange(1, 301, dtype=np.uint64)
    y = np.arange(101, 401, dtype=np.uint64)
    wx, wy = np.where(x % 3 == 0, 4.0, 1.0), np.where(y % 2 == 0, 2.0, 1.0)
    got = (minhash.signature(x, wx, 8192) == minhash.signature(y, wy, 8192)).mean()
    assert got == pytest.approx(minhash.similarity((x, wx), (y, wy)), abs=0.025)
    assert len(set(minhash.signature(np.array([7], np.uint64), np.array([1.0]), 96).tolist())) == 1


def test_classes_equal_all_pairs(spark):
    rows = variants()
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, " "), (2003, "a b"), (2004, "a b"), (2003, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == plain_classes(rows)
    kept = minhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, c in got.items() if d == c)


def test_open_members_of_a_bucket_are_all_compared(spark, monkeypatch):
    """One bucket holds everything, in blocks and chunks of a few rows: the links must find what all pairs find."""
    rows = variants(1, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = docs.select(F.lit(1).cast("long").alias("key"), "doc_id", minhash.copy_key("text").alias("copy_key"))
    for block, chunk in ((5, 7), (1000, 1000)):
        monkeypatch.setattr(minhash, "OPEN_BLOCK", block)
        monkeypatch.setattr(minhash, "MEMBER_CHUNK", chunk)
        labels = {r.doc_id: r.class_id for r in minhash.linked(buckets, docs, 0.8, "doc_id", "text").collect()}
        assert {d: labels.get(d, d) for d, _ in rows} == plain_classes(rows)


def family(n, words=120, edits=2, seed=5):
    """Near copies of a text that is itself not among them, each with its own changed words."""
    rng = np.random.default_rng(seed)
    origin, rows = [f"o{i}" for i in range(words)], []
    for d in range(n):
        own = list(origin)
        for at in rng.choice(words, edits, replace=False):
            own[at] = f"n{d}_{at}"
        rows.append((d, " ".join(own)))
    return rows


def set_classes(rows, threshold=0.8):
    """Classes of all pairs of texts in which no shingle repeats."""
    bags, parent = [], {d: d for d, _ in rows}
    for _, text in rows:
        words = text.split()
        bags.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
        assert len(bags[-1]) == len(words) - 4

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            common = len(bags[i] & bags[j])
            if common >= threshold * (len(bags[i]) + len(bags[j]) - common):
                low, high = sorted((find(a), find(rows[j][0])))
                parent[high] = low
    return {d: find(d) for d in parent}


def test_links_grow_with_the_family(spark, monkeypatch):
    """Without the origin in the table many copies are open. What leaves the tasks are links, fewer than documents per cell,
    and what the join verifies are the pairs with a centre."""
    verify, links, counted = minhash.verify, minhash.open_links, {"pairs": 0, "links": 0}

    def verifying(pairs, texts):
        found = verify(pairs, texts)
        counted["pairs"] += found.count()
        return found

    def linking(members, threshold, whole):
        found = links(members, threshold, whole)
        counted["links"] += found.count()
        return found

    monkeypatch.setattr(minhash, "verify", verifying)
    monkeypatch.setattr(minhash, "open_links", linking)
    totals = []
    for n, words, edits in ((200, 120, 2), (400, 120, 2), (300, 50, 1)):
        counted.update(pairs=0, links=0)
        rows = family(n, words, edits)
        got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == set_classes(rows)
        totals.append((counted["pairs"], counted["links"]))
    assert all(0 < links < 20 * n and pairs < 10 * n for (pairs, links), n in zip(totals, (200, 400, 300), strict=True))


def test_family_equals_all_pairs(spark):
    rows = family(40, words=60, edits=1) + [(100 + d, t) for d, t in family(20, words=60, edits=3, seed=6)]
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set_classes(rows)


def test_similar_to_many_at_once():
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(12)], rng.integers(1, 40))) for _ in range(40)]
    texts += [" ".join(f"v{i}" for i in range(a, a + 30)) for a in range(12)]
    n = len(texts)
    part = minhash.Members(list(range(n)), [0] * n, [True] * n, [0.0] * n, [bytes(minhash.DEEP)] * n, texts)
    for i in (0, 17, 45):
        want = [minhash.similarity(part.shingles[i], part.shingles[j]) for j in range(n)]
        assert np.allclose(part.similar(np.arange(n), part.shingles[i], bool(part.plain[i])), want, atol=1e-12)


def test_one_id_with_several_texts_loses_only_copies(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, b, "x"), (3, c, "x"), (4, c + " more", "x"), (1, None, "x"), (1, "", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id_0 string").repartition(4)
    for _ in range(2):
        kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()), key=str)
        assert kept == sorted([(1, a), (1, b), (3, c), (1, None), (1, ""), (None, a), (None, a)], key=str)
    assert {r.doc_id for r in minhash.classes(docs).collect()} == {1, 2, 3, 4, None}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.class_id for r in minhash.components(edges).collect()} == {0}


def test_classes_of_edge_cases(edge, empty):
    rows = minhash.classes(edge).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: r.class_id for r in rows}
    assert got.pop(None) is None and got == {d: (4 if d == 5 else d) for d in got}
    assert minhash.classes(empty).count() == 0
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == 12


def test_near_duplicate_query(spark, sf, documents):
    got = {r.doc_id: r.class_id for r in QUERIES["op2_near_duplicates"](spark, sf).collect()}
    assert got == plain_classes([(r.doc_id, r.text) for r in documents.collect()])


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, documents):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "near_dedup", "packing"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == documents.columns
        ids = {r.doc_id for r in kept.collect()}
        before = docs.collect()
        if name == "near_dedup":
            classes = plain_classes([(r.doc_id, r.text) for r in before])
            assert ids == {d for d, c in classes.items() if d == c}
        if name == "quality_rules":
            failed = {r.doc_id for r in before if (s := plain_stats(r.text))[0] < 50 or 100 * s[5] > 50 * s[0]}
            assert not ids & failed and ids <= {r.doc_id for r in before}
        docs = kept
    last = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == last


def test_pipeline_stages_on_edge_cases(spark, edge, empty, sf):
    import corpus_pipeline

    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, sf).collect()
            if name != "packing":  # what stays is as it was
                before = Counter(docs.collect())
                assert not Counter(rows) - before and all(r.__fields__ == docs.columns for r in rows)


# --- toxicity with few or no usable labels ----------------------------------------------------------------------------


def test_labels_of_other_documents_do_not_starve_the_fit(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 2 = 0, 'vile awful words', 'kind calm lines') AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 = 0 AS int) AS toxic")
    alone = toxicity.fit_labels(docs, labels.filter("doc_id < 400"), fit_rows=100)
    among = toxicity.fit_labels(docs, labels, fit_rows=100)
    assert among.tells() and among.at.tolist() == alone.at.tolist() and among.value.tolist() == alone.value.tolist()
    scores = docs.select("doc_id", toxicity.score(among, "text").alias("s")).collect()
    assert all((r.s >= 0.5) == (r.doc_id % 2 == 0) for r in scores)


def test_pipeline_keeps_all_documents_without_a_toxic_label(spark, edge, no_labels, tmp_path):
    import corpus_pipeline

    docs = edge.filter("doc_id is not null")
    marks = {
        "none": no_labels,
        "others": spark.createDataFrame([(i, 1, i % 2) for i in range(1000, 1100)], no_labels.schema),
        "clean": spark.createDataFrame([(i, 1, 0) for i in range(10)], no_labels.schema),
    }
    for name, labels in marks.items():
        sf = f"{tmp_path}/{name}"
        labels.write.parquet(f"{sf}/labels.parquet")
        docs.write.parquet(f"{sf}/documents.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, sf).count() == docs.count(), name
        assert {r.predicted for r in QUERIES["op9_toxicity"](spark, sf).collect()} == {0}, name
    many = spark.range(600).selectExpr("id AS doc_id", "'calm words ' || id % 7 AS text")
    weights = toxicity.fit_labels(many, many.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert many.filter(toxicity.score(weights, "text", unknown=0.0) >= 0.5).count() == 0

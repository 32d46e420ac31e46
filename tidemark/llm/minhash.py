"""Near-duplicate classes by ProbMinHash.

A text is a set of shingles weighted by their counts. Every shingle emits a Poisson process of arrivals whose rate is its
weight; an arrival falls on one of ``m`` components, and the first arrival on a component decides it. A shingle stops as
soon as its next arrival comes later than every component's first one. Two texts agree on a component with the
probability Jaccard similarity of their shingles. Texts that agree on a whole band of components are candidates, and
candidates are verified on their texts.

Candidates in a bucket are not paired with each other. All are compared with the bucket's centre, the document that meets
most others in its buckets, and so the likeliest origin of a group of copies. What is then neither near its centre nor
already in one class with the rest of the group meets in blocks, inside the tasks: longer signatures rule most pairs out,
the others are verified there on their shingles, unless a link found before has put both into one class. A task passes on
the links that join classes, at most one less than it has classes, and never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import arrow_map, fresh_names, mix, slices
from tidemark.operators.ordered import with_position
from tidemark.session import materialize

STEP = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no band with probability 3e-6
DEEP = 512  # components of the signatures that decide which open pairs are verified
SIGMAS = 4.5  # an estimate this many deviations below the threshold rules a pair out
OPEN_BLOCK, MEMBER_CHUNK = 1024, 2048  # documents that meet in one task


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of ``size`` words, ascending, and how often each occurs; a shorter text is one shingle."""
    parts = text.encode().split()
    words = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    if not len(words):
        return words, np.zeros(0)
    n = max(1, len(words) - size + 1)
    hashed = words[:n]
    for shift in range(1, min(size, len(words))):
        hashed = mix(hashed) + words[shift : shift + n]
    found, counts = np.unique(mix(hashed), return_counts=True)
    return found, counts.astype(np.float64)


def signature(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """For each of ``m`` components the element that arrives on it first."""
    first, winner = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, late, drawn = elements, np.zeros(len(elements)), 0
    while len(at):
        draws = max(1, 4 * m // len(at)) if drawn == 0 or len(at) < m else 1
        count = np.arange(drawn + 1, drawn + draws + 1, dtype=np.uint64) * STEP
        bits = mix(at[:, None] + count[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
        times = late[:, None] + np.cumsum(gaps, axis=1)
        component = ((mix(bits ^ STEP) >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        better = times < first[component]
        t, c = times[better], component[better]
        order = np.argsort(-t, kind="stable")  # of several arrivals on a component the earliest is written last
        first[c[order]] = t[order]
        winner[c[order]] = np.broadcast_to(at[:, None], times.shape)[better][order]
        late, drawn = times[:, -1], drawn + draws
        go_on = late < first.max()
        at, late, weights = at[go_on], late[go_on], weights[go_on]
    return winner


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = winner.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for r in range(rows):
        keys = mix(keys + parts[:, r])
    return keys.view(np.int64)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity: sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    _, in_x, in_y = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(in_x):
        return 0.0
    a, b = x[1][in_x], y[1][in_y]
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    only_x, only_y = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    start = np.searchsorted(ratio, ratio, side="left")  # j from here on has x_j / y_j >= x_i / y_i
    from_here = a.sum() - np.concatenate([[0.0], np.cumsum(a)])[start]
    till_here = np.concatenate([[0.0], np.cumsum(b)])[start]
    return float((1.0 / ((only_x + from_here) / a + (only_y + till_here) / b)).sum())


def sketch(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, copy_key, keys`` of every text with a word; equal texts have one copy key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, copy, texts in slices(batches):
            out = {"doc_id": [], "copy_key": [], "keys": []}
            for doc_id, key, text in zip(ids, copy, texts, strict=True):
                found, counts = shingles(text or "")
                if len(found):
                    out["doc_id"].append(doc_id)
                    out["copy_key"].append(key)
                    out["keys"].append(band_keys(signature(found, counts, bands * rows), bands, rows))
            yield out

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), copy_key(text_col).alias("copy_key"), F.col(text_col).alias("text"))
    return arrow_map(named.filter("doc_id is not null"), run, "doc_id long, copy_key binary, keys array<long>")


def copy_key(text: str) -> F.Column:
    return F.unhex(F.md5(text))


def texts_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored ``doc_id, text`` of the wanted documents (``doc_id, copy_key``); the only shuffle of texts, the same at every
    size."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), copy_key(text_col).alias("copy_key"), F.col(text_col).alias("text"))
    return materialize(texts.join(wanted.hint("merge"), ["doc_id", "copy_key"]).dropDuplicates(["doc_id"]).select("doc_id", "text"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs ``a, b`` of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, held = None, None
        for a, b, text_a, text_b in slices(batches, 64):
            found = []
            for i in range(len(a)):
                if a[i] != known:
                    known, held = a[i], shingles(text_a[i])
                found.append(similarity(held, shingles(text_b[i])))
            yield {"a": a, "b": b, "similarity": found}

    of = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
    joined = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
    return materialize(arrow_map(joined, run, "a long, b long, similarity double"))


def deep_signatures(texts: DataFrame) -> DataFrame:
    """``doc_id, text, deep``: the low byte of each of ``DEEP`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, parts in slices(batches):
            deep = [(signature(*shingles(t), DEEP) & np.uint64(255)).astype(np.uint8).tobytes() for t in parts]
            yield {"doc_id": ids, "text": parts, "deep": deep}

    return arrow_map(texts.select("doc_id", "text"), run, "doc_id long, text string, deep binary")


def open_links(members: DataFrame, threshold: float, whole: bool) -> DataFrame:
    """``a, b``: verified links between classes, of open members with members of other classes of their group.

    ``members``: grp, doc_id, class_id, open, far (distance to the centre), text, deep. Open members are dealt to blocks and
    all members to chunks of bounded size. If ``whole``, every block meets every chunk of its group in one cell, block first;
    otherwise each block meets one chunk, and each chunk one block at least.
    """
    counts = members.groupBy("grp").agg(F.count(F.when(F.col("open"), 1)).alias("opens"), F.count(F.lit(1)).alias("n"))
    dealt = members.join(counts.filter("opens > 0"), "grp")
    blocks, chunks = (F.ceil(F.col(c) / s).cast("int") for c, s in (("opens", OPEN_BLOCK), ("n", MEMBER_CHUNK)))
    pick = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n).cast("int")

    def met(own, mine, other):
        fewer = F.least(mine, other)
        return F.filter(F.sequence(F.lit(0), other - 1), lambda x: F.lit(whole) | (F.pmod(x, fewer) == F.pmod(own, fewer)))

    columns = ["doc_id", "class_id", "open", "far", "deep", "text"]
    left = dealt.filter("open").select("grp", *columns, F.lit(0).alias("side"), pick(blocks, 1).alias("block"), chunks.alias("_n"), blocks.alias("_m"))
    left = left.withColumn("chunk", F.explode(met(F.col("block"), F.col("_m"), F.col("_n"))))
    right = dealt.select("grp", *columns, F.lit(1).alias("side"), pick(chunks, 2).alias("chunk"), blocks.alias("_n"), chunks.alias("_m"))
    right = right.withColumn("block", F.explode(met(F.col("chunk"), F.col("_m"), F.col("_n"))))
    cell = ["grp", "block", "chunk"]
    rows = [*cell, "side", *columns]
    met_rows = left.select(rows).unionByName(right.select(rows)).repartition(*cell).sortWithinPartitions(*cell, "side", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = None
        for *where, side, ids, classes, opens, fars, deep, texts in slices(batches):
            start, keys = 0, list(zip(*where, side, strict=True))
            while start < len(ids):
                end = start
                while end < len(ids) and keys[end] == keys[start]:
                    end += 1
                if now is None or now.key != keys[start][:3]:
                    now = Cell(keys[start][:3], threshold)
                part = Members(ids[start:end], classes[start:end], opens[start:end], fars[start:end], deep[start:end], texts[start:end])
                if side[start] == 0:
                    now.left.append(part)
                else:
                    yield now.meet(part)
                start = end

    return arrow_map(met_rows.select(rows), run, "a long, b long")


class Members:
    """Documents as arrays, with their shingles."""

    def __init__(self, ids: list, classes: list, opens: list, fars: list, deep: list, texts: list):
        self.ids, self.classes, self.opens, self.fars = np.array(ids), np.array(classes), np.array(opens), np.array(fars)
        self.deep = np.frombuffer(b"".join(deep), np.uint8).reshape(-1, DEEP)
        self.shingles = [shingles(t) for t in texts]
        self.plain = np.array([bool((counts == 1).all()) for _, counts in self.shingles])

    def similar(self, at: np.ndarray, own: tuple[np.ndarray, np.ndarray], plain: bool) -> np.ndarray:
        """Exact similarity of some of them to a document; where no shingle repeats, it is plain Jaccard, for all at once."""
        out, simple = np.zeros(len(at)), self.plain[at] & plain
        for i in np.flatnonzero(~simple):
            out[i] = similarity(own, self.shingles[at[i]])
        some = [self.shingles[j][0] for j in at[simple]]
        if some:
            sizes = np.array([len(x) for x in some])
            every, mine = np.concatenate(some), own[0]
            common = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            shared = np.add.reduceat(common, np.cumsum(sizes) - sizes, dtype=np.int64)
            out[simple] = shared / (sizes + len(mine) - shared)
        return out


class Cell:
    """One block of open members, which chunks of members meet one part after the other."""

    def __init__(self, key: tuple, threshold: float):
        self.key, self.threshold, self.reach = key, threshold, 1.0 - threshold + 1e-9
        self.least = DEEP * (threshold - SIGMAS * float(np.sqrt(threshold * (1 - threshold) / DEEP)))
        self.left: list[Members] = []
        self.into: dict[int, int] = {}  # classes that are known to be part of another

    def root(self, class_id: int) -> int:
        while class_id in self.into:
            class_id = self.into[class_id]
        return class_id

    def meet(self, part: Members) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        roots = np.array([self.root(c) for c in part.classes.tolist()])
        for block in self.left:
            for i in range(len(block.ids)):
                own = self.root(int(block.classes[i]))
                # a pair of open members meets twice when all cells are done; once is enough
                at = (roots != own) & (np.abs(part.fars - block.fars[i]) <= self.reach) & ~(part.opens & (part.ids < block.ids[i]))
                at = np.flatnonzero(at)
                at = at[(part.deep[at] == block.deep[i]).sum(axis=1, dtype=np.int32) >= self.least]
                if not len(at):
                    continue
                near = at[part.similar(at, block.shingles[i], bool(block.plain[i])) >= self.threshold]
                for j in near.tolist():
                    if roots[j] != own:
                        out["a"].append(int(block.ids[i]))
                        out["b"].append(int(part.ids[j]))
                        self.into[int(roots[j])] = own
                        roots[roots == roots[j]] = own
        return out


def linked(buckets: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, class_id`` of the documents in a class of several: verified links connect all candidates of similarity
    ``threshold`` or more.

    ``buckets``: key, doc_id, copy_key, with two or more documents to a key. The members of all buckets with one centre form
    a group. A member is open if its similarity to the centre is below the threshold. Every open member is compared with all
    members of its groups that are in another class, unless the triangle inequality for 1 - similarity, a metric, or the
    estimate from ``DEEP`` components rules the pair out (for a pair at the threshold with a probability of 4e-6). There is
    no cap. Groups of several cells meet in two waves: the first, of as many cells as there are blocks or chunks, joins most
    classes, so that the second, of all cells, has few links to pass on.
    """
    met = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
    score = buckets.join(met, "key").groupBy("doc_id").agg(F.sum("met").alias("score"))
    scored = buckets.join(score, "doc_id").select("key", "doc_id", F.struct("score", (-F.col("doc_id")).alias("low")).alias("rank"))
    centre = scored.groupBy("key").agg(F.max("rank").alias("rank")).select("key", (-F.col("rank.low")).alias("a"))
    pairs = materialize(buckets.join(centre, "key").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    texts = texts_of(buckets.select("doc_id", "copy_key").distinct(), docs, id_col, text_col)
    checked = verify(pairs, texts)
    labels = components(checked.filter(F.col("similarity") >= threshold).select("a", "b"))
    near = checked.select(
        F.col("a").alias("grp"), F.col("b").alias("doc_id"), (F.col("similarity") < threshold).alias("open"), (1 - F.col("similarity")).alias("far")
    )
    members = materialize(unsettled(near, labels))
    largest = members.groupBy("grp").count().agg(F.max("count")).first()[0]
    if largest is None:
        return labels
    deep = materialize(deep_signatures(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi")))
    for whole in (True,) if largest <= min(OPEN_BLOCK, MEMBER_CHUNK) else (False, True):
        joined = materialize(open_links(members.join(deep, "doc_id"), threshold, whole).distinct())
        if joined.isEmpty():
            continue
        labels = materialize(relabelled(labels, joined))
        if not whole:
            members = materialize(unsettled(members.drop("class_id"), labels))
    return labels


def relabelled(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """Labels after some more links: only the classes that these join are connected anew, not all links again."""
    class_of = lambda side: F.coalesce(f"class_{side}", side).alias(side)
    named = joined
    for side in ("a", "b"):
        named = named.join(labels.select(F.col("doc_id").alias(side), F.col("class_id").alias(f"class_{side}")), side, "left")
    merged = components(named.select(class_of("a"), class_of("b")).filter("a <> b"))
    merged = merged.select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("into"))
    ends = joined.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(labels, "doc_id", "left_anti")
    every = labels.unionByName(ends.withColumn("class_id", F.col("doc_id")))
    return every.join(merged, "class_id", "left").select("doc_id", F.coalesce("into", "class_id").alias("class_id"))


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their class, of groups with an open member and more than one class."""
    named = members.join(labels, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    mixed = named.groupBy("grp").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.max("open").alias("any"))
    return named.join(mixed.filter("any and low < high").select("grp"), "grp", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, class_id`` of every document in a link: the smallest id that it is connected to.

    Each round takes the smallest label among the neighbours and then that label's own label, so paths halve; rounds are
    written to the shared folder.
    """
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("doc_id"), F.min("b")).alias("class_id")))
    while True:
        offered = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("class_id").alias("offer"))
        lower = labels.join(offered, "doc_id").select("doc_id", F.col("class_id").alias("old"), F.least("class_id", "offer").alias("class_id"))
        jump = labels.select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("next"))
        lower = materialize(lower.join(jump, "class_id").select("doc_id", "old", F.least("class_id", "next").alias("class_id")))
        if lower.filter("old <> class_id").isEmpty():
            return lower.select("doc_id", "class_id")
        labels = lower.select("doc_id", "class_id")


def classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, class_id`` of every row of ``docs``; ``class_id`` is the smallest id of the class.

    Words are what the six ASCII blanks separate; similarity is the probability Jaccard similarity of counted five-word
    shingles (a shorter text is one shingle). A null text or one without a word is alone in its class. Rows that share an
    id are one document, whose text is the one of the smallest MD5; a null id has the class null. Equal texts are sketched,
    but only their smallest id takes part in the search. An empty table gives no rows.
    """
    sketches = materialize(sketch(docs, bands, rows, id_col, text_col))
    texts = materialize(sketches.groupBy("doc_id").agg(F.min("copy_key").alias("copy_key")))
    smallest = materialize(texts.groupBy("copy_key").agg(F.min("doc_id").alias("rep")))
    searched = sketches.join(smallest.select(F.col("rep").alias("doc_id"), "copy_key"), ["doc_id", "copy_key"], "left_semi")
    keys = searched.select("doc_id", "copy_key", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    buckets = materialize(keys.join(shared.select("key"), "key", "left_semi").distinct())
    labels = linked(buckets, docs, threshold, id_col, text_col)
    reps = texts.join(smallest, "copy_key").select("doc_id", "rep")
    placed = reps.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(placed, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every class only: the one of the smallest id, and of its texts, if it has several, the one of
    the smallest MD5.

    Each (id, text) is a document of its own here, so rows that share an id lose only copies. Rows with a null id stay, as
    they are. Null, empty and blank texts are near no text: they stay, one row for each id and text. Where no id has several
    texts, ids stand for them; otherwise all are numbered, in order of id and text, which moves the texts once more.
    """
    text_key = F.coalesce(F.md5(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key.alias("text_key"))
    keyed = keyed.filter("doc_id is not null")
    ids = keyed.groupBy("doc_id").agg(F.min("text_key").alias("text_key"), F.max("text_key").alias("last"))
    if ids.filter("text_key < last").isEmpty():
        units = ids.select(F.col("doc_id").alias("unit"), "doc_id", "text_key")
        texts = keyed.withColumnRenamed("doc_id", "unit")
    else:
        units = with_position(keyed.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "unit")
        units = materialize(units.select("unit", "doc_id", "text_key"))
        texts = keyed.join(units, ["doc_id", "text_key"])
    found = classes(texts.select("unit", "text"), id_col="unit", text_col="text", **options)
    left = materialize(units.join(found.filter("doc_id = class_id").select(F.col("doc_id").alias("unit")).distinct(), "unit", "left_semi"))
    inside = fresh_names(docs, "id", "text")
    named = docs.filter(F.col(id_col).isNotNull()).withColumns({inside[0]: F.col(id_col).cast("long"), inside[1]: text_key})
    wanted = left.select(F.col("doc_id").alias(inside[0]), F.col("text_key").alias(inside[1]))
    kept = named.join(wanted, inside, "left_semi").dropDuplicates(inside).select(docs.columns)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))

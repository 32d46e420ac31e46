"""Quality rules whose cutoffs carry a guarantee.

A rule rejects texts whose measure lies above a cutoff. Labelled rows are split in two: one half only proposes cutoffs
(quantiles of the measure), the other, the holdout, decides. A cutoff is certified for a stratum when the exact binomial
test refutes, on the stratum's good holdout rows, that the rule rejects more than its share of ``risk``. Cutoffs are tried
from the loosest to the strictest and the walk ends at the first that fails, so a sequence needs no correction of its
own; the level is divided by the number of sequences (strata x rules). All certified cutoffs of all strata hold together
with probability ``1 - level``, so the one that pays best may be picked among them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE, worker_cache
from tidemark.session import materialize

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"  # fixed values of the rule
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
STATS_TYPE = f"struct<{','.join(f'{s}:bigint' for s in STATS)}>"


class WordNumbers(dict):
    """Consecutive numbers of words; emptied between texts once it holds ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeated_words(words: np.ndarray, window: int = 3) -> int:
    """Words that lie in a window of consecutive words found at least twice; ``words`` are word numbers."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    keys = words[:n]
    for shift in range(1, window):
        top = int(words.max()) + 1
        if int(keys.max(initial=0)) >= (1 << 62) // top:  # renumber before the product leaves 64 bits
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        keys = keys * top + words[shift : shift + n]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(keys, twice)
    covered = np.zeros(len(words), bool)
    for shift in range(window):
        covered[shift : shift + n] |= found
    return int(covered.sum())


def text_stats(text: str | None, numbers: WordNumbers) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()  # of bytes: splits at exactly the six blanks
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text or "") - (len(data) - len(data.translate(None, BLANKS))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(numbers.of(words)),
    )


def stats_of(text: Column | str) -> Column:
    """Counts of a whole text as one struct; a null text has no words."""

    @F.arrow_udf(STATS_TYPE)
    def stats(texts: pa.Array) -> pa.Array:
        numbers = worker_cache("quality words", WordNumbers)
        rows = [text_stats(t, numbers) for i in range(0, len(texts), SLICE) for t in texts.slice(i, SLICE).to_pylist()]
        counts = np.array(rows, np.int64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=list(STATS))

    return stats(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED_PERCENT * s["n_words"])


def measures(s: Column) -> dict[str, Column]:
    """What the rules look at; larger is worse."""
    words, lines = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["n_lines"], F.lit(1))
    return {
        "symbols": s["n_symbols"] / words,
        "repeats": s["n_repeat_words"] / words,
        "copied lines": s["n_dup_lines"] / lines,
        "long words": s["word_chars"] / words,
        "short words": -s["word_chars"] / words,
    }


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial variable, summed exactly over all its terms."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1, dtype=np.float64)
    log_choose = np.concatenate([[0.0], np.cumsum(np.log(np.arange(n, n - k, -1.0)) - np.log(i[1:]))])
    terms = log_choose + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(0.0, top + math.log(np.exp(terms - top).sum())))


def certified(good: list[int], n_good: int, risk: float, level: float) -> int:
    """Number of leading cutoffs, loosest first, that pass; ``good`` counts the good rows that each rejects."""
    for i, k in enumerate(good):
        if log_binomial_tail(k, n_good, risk) > math.log(level):
            return i
    return len(good)


def pick(cutoffs: list[float], good: list[int], bad: list[int], n_good: int, risk: float, level: float, price: float):
    """The certified cutoff with the largest gain, bad rejected less ``price`` x good rejected; the loosest on ties, None
    when none is certified or none gains."""
    best = None
    for i in range(certified(good, n_good, risk, level)):
        gain = bad[i] - price * good[i]
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, i)
    return None if best is None else (cutoffs[best[1]], good[best[1]], bad[best[1]])


DECIDED = "rule string, cutoff double, n_good long, good_rejected long, bad_rejected long"
POOL = "\0pooled"  # no name of a stratum
FEW = 20_000  # rows of strata or cutoffs that are broadcast; a cutoff list has less than 100 numbers


def least_rows(risk: float, level: float) -> int:
    """Good holdout rows below which not even a cutoff that rejects none of them can be certified."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def thresholds(
    rows: DataFrame, risk: float = 0.05, level: float = 0.05, price: float = 20.0, grid: int = 64, stratum: str = "stratum"
) -> DataFrame:
    """``stratum, rule, cutoff, n_good, good_rejected, bad_rejected, pooled`` from labelled rows.

    ``rows``: stratum, stats, quality (1 good, 0 bad), propose (which half). Rows that fail the base rules or have no
    label take no part. Strata whose good holdout rows are too few to certify anything form one pooled stratum: its cutoffs
    hold for each of them, and the guarantee is over all their rows together. A stratum without labelled rows has no cutoff,
    nor has the pool if it is too small itself: their texts are kept. Each rule may spend ``risk`` divided by the number of
    rules, so all rules of a stratum together stay below ``risk``; ``level`` is divided by rules times strata.
    """
    s = F.col("stats")
    rules = len(measures(s))
    usable = rows.filter(~base_failed(s) & F.col("quality").isin(0, 1))
    named = F.array(*[F.struct(F.lit(n).alias("rule"), m.cast("double").alias("value")) for n, m in measures(s).items()])
    long = usable.select(F.coalesce(F.col(stratum), F.lit("")).alias("own"), "quality", "propose", F.explode(named).alias("m"))
    long = materialize(long.select("own", "quality", "propose", "m.rule", "m.value"))
    proving = F.count(F.when(~F.col("propose") & (F.col("quality") == 1), 1))  # each row stands here once per rule
    sizes = materialize(long.groupBy("own").agg(F.floor(proving / rules).alias("n")))
    strata = sizes.count()
    if strata == 0:
        return rows.sparkSession.createDataFrame([], "stratum string, " + DECIDED + ", pooled boolean")
    tests = rules * strata
    pooled = F.col("n") < least_rows(risk / rules, level / tests)
    groups = sizes.select("own", pooled.alias("pooled"), F.when(pooled, POOL).otherwise(F.col("own")).alias("stratum"))
    few = lambda df, n: F.broadcast(df) if n <= FEW else df  # noqa: E731  strata and their cutoffs are counted
    long = long.join(few(groups, strata), "own")
    shares = F.array(*[F.lit(i / grid) for i in range(grid)])
    tail = F.array(*[F.lit(1 - 2.0**-i) for i in range(1, 17)])
    good_value = F.when(F.col("quality") == 1, F.col("value"))
    cuts = long.filter("propose").groupBy("stratum", "rule")
    cuts = cuts.agg(F.percentile_approx("value", shares, 10_000).alias("all"), F.percentile_approx(good_value, tail, 10_000).alias("good"))
    both = F.concat(F.coalesce("all", F.array()), F.coalesce("good", F.array()))
    cuts = materialize(cuts.select("stratum", "rule", F.array_distinct(F.array_sort(both)).alias("cuts")))
    counted = (
        long.filter("not propose")
        .join(few(cuts, tests), ["stratum", "rule"])
        .select("stratum", "rule", "quality", F.aggregate("cuts", F.lit(0), lambda n, c: n + (F.col("value") > c).cast("int")).alias("above"))
        .groupBy("stratum", "rule", "above", "quality")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(few(cuts, tests), ["stratum", "rule"])
    )

    def decide(key, part):
        import pandas as pd

        cutoffs = list(part["cuts"].iloc[0])[::-1]  # loosest first
        good, bad = np.zeros(len(cutoffs) + 1), np.zeros(len(cutoffs) + 1)
        for above, quality, n in part[["above", "quality", "n"]].itertuples(index=False):
            (good if quality == 1 else bad)[above] += n
        # a value above ``a`` cutoffs of the ascending list is rejected by cutoffs 0 .. a-1 of it
        rejected_good, rejected_bad = (x[::-1].cumsum()[:-1].astype(int).tolist() for x in (good, bad))
        found = pick(cutoffs, rejected_good, rejected_bad, int(good.sum()), risk / rules, level / tests, price)
        rows = [] if found is None else [(*key, found[0], int(good.sum()), found[1], found[2])]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "good_rejected", "bad_rejected"])

    decided = counted.groupBy("stratum", "rule").applyInPandas(decide, "stratum string, " + DECIDED)
    each = decided.join(few(groups, strata), "stratum").withColumn("stratum", F.col("own"))
    return each.select("stratum", "rule", "cutoff", "n_good", "good_rejected", "bad_rejected", "pooled")


def judged(
    docs: DataFrame, labels: DataFrame, stratum: str, id_col: str, text_col: str, columns: list[str] | None, **options
) -> DataFrame:
    """``row`` (a struct of the wanted columns, so that no name can clash), ``stats``, ``base_failed``, ``kept``."""
    name = lambda c: F.col(f"`{c}`")
    row = F.struct(*[name(c) for c in (docs.columns if columns is None else columns)])
    own = F.coalesce(name(stratum).cast("string"), F.lit(""))
    measured = materialize(docs.select(row.alias("row"), name(id_col).alias("id"), own.alias("stratum"), stats_of(name(text_col)).alias("stats")))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    rows = measured.select("id", "stratum", "stats").join(marks, "id").dropDuplicates(["id"])
    limits = materialize(thresholds(rows.withColumn("propose", F.xxhash64(F.lit("propose"), "id") % 2 == 0), **options))
    by_rule = limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    s, rejected = F.col("stats"), F.lit(False)
    for rule_name, measure in measures(s).items():
        rejected = rejected | F.coalesce(measure > F.col("limits")[rule_name], F.lit(False))
    found = measured.join(by_rule, "stratum", "left").withColumn("base_failed", base_failed(s))
    return found.select("row", "stats", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def rule(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: list[str] | None = None,
    **options,
) -> DataFrame:
    """``columns`` of ``docs`` (all, if None) plus ``_stats``, ``_base_failed`` and ``_kept``; columns of these three names
    that ``docs`` may have are replaced.

    A null text has no words and fails the base rules, as an empty one does. Repeated rows get the same verdict. Null
    strata form a stratum. Labels of unknown documents, null labels and repeated labels of a document (the lower counts)
    do no harm; of a document's several texts one is measured for its label. Texts are measured once; the rows with their
    counts are stored and joined to one small row per stratum.
    """
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in ("_stats", "_base_failed", "_kept")]
    found = judged(docs, labels, stratum, id_col, text_col, wanted, **options)
    return found.select("row.*", F.col("stats").alias("_stats"), F.col("base_failed").alias("_base_failed"), F.col("kept").alias("_kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and all cutoffs of their stratum, with the columns they had."""
    return judged(docs, labels, stratum, id_col, text_col, None, **options).filter("kept").select("row.*")

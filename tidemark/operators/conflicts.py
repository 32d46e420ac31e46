"""Conflicts between an old and a new text, and their resolution.

A pair of texts is one row, and everything the detectors compare comes from that row, so detection needs no join and no
exchange. The entries of the old side are exploded, each meets the new side's entries of its own kind, and those that
clash are exploded in turn. Both texts stay behind: exploded rows hold entries, and the two texts only where the conflict is
between the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.records import numeric_literal, relative_difference
from tidemark.functions.text import let, words

# Detector order and confidences.
DETECTORS = {"factual": 0, "numerical": 1, "temporal": 2, "entity": 3}
CONFIDENCE = {"numerical": 0.8, "temporal": 0.9, "entity": 0.7}
NUMERIC_THRESHOLD = 0.1
CONFIDENCE_THRESHOLD = 0.7
STRATEGIES = ("newest_wins", "confidence_based", "merge")

_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
_DAY = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
DATE = (
    rf"\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b|\bQ[1-4](?: [0-9]{{4}})?\b"
    rf"|\b(?:{_MONTH})(?: [0-9]{{1,2}})?(?:,? [0-9]{{4}})?\b|\b(?:{_DAY})\b"
)
NUMBER = r"[0-9]+(?:\.[0-9]+)*"
NAME = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"
NEGATIONS = ("not", "no", "never", "none", "without", "cannot", "denied", "denies")


def date_phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), F.lit(0))


def _parts(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the entity texts of each kind: ``names``, ``dates``, ``numbers``; every pattern runs once."""

    def kinds(t: Column) -> Column:
        return let(F.regexp_replace(t, DATE, " | "), lambda rest: F.struct(
            F.regexp_extract_all(rest, F.lit(NAME), F.lit(0)).alias("names"),
            date_phrases(t).alias("dates"),
            F.filter(
                F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(0)), lambda n: numeric_literal(n).isNotNull()
            ).alias("numbers"),
        ))

    return let(kinds(text), body)


def numbers(text: Column) -> Column:
    """Number texts, dates left out, kept when they are plain numeric literals."""
    return _parts(text, lambda p: p["numbers"])


def names(text: Column) -> Column:
    """Runs of capitalised words, dates left out."""
    return _parts(text, lambda p: p["names"])


def extract_entities(text: Column) -> Column:
    """All entity texts in the order names, dates, numbers."""
    return _parts(text, lambda p: F.concat(p["names"], p["dates"], p["numbers"]))


def negation_rule(old: Column, new: Column) -> Column:
    """Default contradiction score: word overlap (Jaccard, at least one half) when one side alone holds a negation."""
    a, b = F.array_distinct(words(old)), F.array_distinct(words(new))
    overlap = F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
    marks = F.array(*[F.lit(n) for n in NEGATIONS])
    one_sided = F.arrays_overlap(a, marks) != F.arrays_overlap(b, marks)
    return F.when(one_sided & (overlap >= 0.5), overlap)


def _distinct(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(texts))


def _mine(text: Column, factual: Column, detectors: Sequence[str]) -> Column:
    """What the old text offers to the detectors, in their order. ``factual``: the entry for a clash of the whole texts."""

    def entries(texts: Column, detector: str, label: str) -> Column:
        return F.transform(texts, lambda t: _entry(detector, label, t))

    def offered(p: Column) -> Column:
        parts = [F.filter(F.array(factual), lambda e: e["other"].isNotNull())]
        if "numerical" in detectors:
            parts.append(entries(p["numbers"], "numerical", "CARDINAL"))
        if "temporal" in detectors:
            parts.append(entries(p["dates"], "temporal", "DATE"))
        if "entity" in detectors:  # labels in alphabetical order
            parts += [entries(_distinct(p[c]), "entity", n) for c, n in (("numbers", "CARDINAL"), ("dates", "DATE"), ("names", "NAME"))]
        return F.concat(*parts)

    return _parts(text, offered)


def _entry(detector: str, label: str, text: Column, other: Column | None = None, entities: Column | None = None) -> Column:
    return F.struct(
        F.lit(DETECTORS[detector]).alias("detector"),
        F.lit(label).alias("label"),
        text.alias("text"),
        (F.lit(None).cast("string") if other is None else other).alias("other"),
        (F.lit(None).cast("array<string>") if entities is None else entities).alias("entities"),
    )


def _theirs(text: Column) -> Column:
    """What the new text holds against them: numbers and dates as they stand, and each label's entities once."""
    return _parts(text, lambda p: F.struct(
        F.transform(p["numbers"], lambda n: F.struct(n.alias("text"), n.try_cast("double").alias("number"))).alias("numbers"),
        p["dates"].alias("dates"),
        F.create_map(
            F.lit("CARDINAL"), _distinct(p["numbers"]), F.lit("DATE"), _distinct(p["dates"]), F.lit("NAME"), _distinct(p["names"])
        ).alias("entities"),
    ))


def _opposing(e: Column, theirs: Column) -> Column:
    """Texts of the new side that clash with an entry."""
    number = e["text"].try_cast("double")

    def far(n: Column) -> Column:
        return F.coalesce(relative_difference(number, n["number"]) > NUMERIC_THRESHOLD, F.lit(False))

    return (
        F.when(e["detector"] == DETECTORS["factual"], F.array(e["other"]))
        .when(e["detector"] == DETECTORS["numerical"], F.filter(theirs["numbers"], far)["text"])
        .when(e["detector"] == DETECTORS["temporal"], F.array_remove(theirs["dates"], e["text"]))
        .otherwise(F.array_remove(theirs["entities"][e["label"]], e["text"]))
    )


def detect_conflicts(
    pairs: DataFrame,
    pair_id: str = "pair_id",
    old: str = "old_content",
    new: str = "new_content",
    contradiction: Callable[[Column, Column], Column] = negation_rule,
    detectors: Sequence[str] = tuple(DETECTORS),
) -> DataFrame:
    """Every conflict of every pair: ``seq`` orders them (factual, numerical, temporal, entity), then by entry.

    Only the named ``detectors`` run.
    """
    if unknown := set(detectors) - set(DETECTORS):
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    score = contradiction(F.col(old), F.col(new)) if "factual" in detectors else F.lit(None).cast("double")
    scored = pairs.select(pair_id, F.col(old).alias("_old"), F.col(new).alias("_new"), score.alias("_score"))
    when = lambda value: F.when(F.col("_score").isNotNull(), value)
    factual = _entry("factual", "", F.col("_old"), when(F.col("_new")), when(extract_entities(F.concat_ws(" ", "_old", "_new"))))
    entries = scored.select(pair_id, "_score", _mine(F.col("_old"), factual, detectors).alias("_mine"), _theirs(F.col("_new")).alias("_theirs"))
    exploded = entries.select(pair_id, "_score", "_theirs", F.posexplode("_mine").alias("_i", "_e"))
    flat = exploded.select(pair_id, "_score", "_i", "_e", F.posexplode(_opposing(F.col("_e"), F.col("_theirs"))).alias("_j", "_other"))
    kind = F.element_at(F.array(*[F.lit(d) for d in DETECTORS]), F.col("_e.detector") + 1)
    confidence = F.col("_score")
    for name, value in CONFIDENCE.items():
        confidence = F.when(F.col("_e.detector") == DETECTORS[name], F.lit(value)).otherwise(confidence)
    return flat.select(
        pair_id,
        F.struct(F.col("_e.detector").alias("detector"), F.col("_i").alias("old_no"), F.col("_j").alias("new_no")).alias("seq"),
        kind.alias("type"),
        F.col("_e.text").alias("old_content"),
        F.col("_other").alias("new_content"),
        confidence.alias("confidence"),
        F.coalesce(F.col("_e.entities"), F.array("_e.text", "_other")).alias("entities_involved"),
        F.lit("newest_wins").alias("resolution_strategy"),
    )


def merged_text(kind: Column, old: Column, new: Column) -> Column:
    # The four merge templates.
    return (
        F.when(kind == "numerical", F.concat(new, F.lit(" (previously reported as "), old, F.lit(")")))
        .when(kind == "temporal", F.concat(new, F.lit(" (updated from "), old, F.lit(")")))
        .when(kind == "entity", F.concat(new, F.lit(" (formerly "), old, F.lit(")")))
        .otherwise(F.concat(new, F.lit(" [Note: This conflicts with earlier version: "), old, F.lit("]")))
    )


def resolve_conflicts(
    conflicts: DataFrame, strategy: str = "newest_wins", pair_id: str = "pair_id", seq: str = "seq"
) -> DataFrame:
    """One resolution per pair: the first conflict gives the versions, the last one the outcome. Pairs without a
    conflict have no row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown resolution strategy: {strategy}")
    ends = conflicts.groupBy(pair_id).agg(
        F.min_by(F.struct("old_content", "new_content"), F.col(seq)).alias("_first"),
        F.max_by(F.struct("type", "old_content", "new_content", "confidence"), F.col(seq)).alias("_last"),
    )
    kind, old, new, conf = (F.col(f"_last.{c}") for c in ("type", "old_content", "new_content", "confidence"))
    if strategy == "newest_wins":
        content, score = new, conf
        extra = {"original_conflict_type": kind}
    elif strategy == "confidence_based":
        wins = conf > CONFIDENCE_THRESHOLD
        content, score = F.when(wins, new).otherwise(old), F.when(wins, conf).otherwise(F.lit(1) - conf)
        extra = {"confidence_threshold": F.lit(str(CONFIDENCE_THRESHOLD))}
    else:
        content, score = merged_text(kind, old, new), F.lit(0.5)
        extra = {}
    entries = [F.lit("strategy"), F.lit(strategy)]
    for key, value in extra.items():
        entries += [F.lit(key), value]
    return ends.select(
        pair_id,
        F.col("_first.old_content").alias("original_version"),
        F.col("_first.new_content").alias("new_version"),
        content.alias("resolved_content"),
        score.alias("confidence_score"),
        F.create_map(*entries).alias("resolution_metadata"),
    )

"""Repetition inside a single document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.runs import word_key
from segloom.runtime import cut

STRETCH = 5
SHARE = 0.4
#: About so many labelled rows are used for a calibration; all there are, if there are fewer.
HOLDOUT_ROWS = 100_000
#: Most of a stratum's clean candidates that may be rejected wrongly, and the chance that any bound fails.
ALPHA = 0.03
DELTA = 0.05
#: Most false rejections a cutoff may show in the holdout itself.
SEEN = 0
GRID = tuple(round(0.40 + 0.05 * k, 2) for k in range(12))


def repeated_share(words: list[str], stretch: int = STRETCH) -> float:
    """Share of words within a stretch of ``stretch`` words that has already begun earlier in the same text."""
    n = len(words)
    if n <= stretch:
        return 0.0
    seen: set[tuple[str, ...]] = set()
    covered, until = 0, 0
    for i in range(n - stretch + 1):
        gram = tuple(words[i : i + stretch])
        if gram in seen:
            covered += i + stretch - max(i, until)
            until = i + stretch
        else:
            seen.add(gram)
    return covered / n


def duplicate_share(words: list[str]) -> float:
    """Share of words that occurred before in the text; never below :func:`repeated_share`."""
    return 1 - len(set(words)) / len(words) if words else 0.0


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound: with confidence 1 - delta the rate behind k of n is not above it."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if p < 1 else 0.0
        low, high = (p, high) if tail > delta else (low, p)
    return high


def choose_cutoffs(
    labelled: list[tuple[str | None, float, bool]], alpha: float = ALPHA, delta: float = DELTA, grid: tuple[float, ...] = GRID, seen: int = SEEN
) -> dict[str | None, tuple[float, float, int]]:
    """Per stratum the lowest cutoff of the grid with a certified false-rejection rate.

    ``labelled`` holds (stratum, score, is it repetitive). A false rejection is a clean text scoring at or above the
    cutoff. Its rate is bounded by an exact binomial bound at confidence 1 - delta / (cutoffs x strata)
    (Bonferroni), so all bounds hold together. A cutoff with more than ``seen`` false rejections is not used. Gives (cutoff, bound, clean texts); a stratum with no certified
    cutoff gets an infinite one and rejects nothing.
    """
    clean: dict[str | None, list[float]] = {}
    for stratum, score, repetitive in labelled:
        group = clean.setdefault(stratum, [])
        if not repetitive:
            group.append(score)
    level = delta / max(1, len(clean) * len(grid))
    out: dict[str | None, tuple[float, float, int]] = {}
    for stratum, scores in clean.items():
        out[stratum] = (math.inf, 1.0, len(scores))
        for cutoff in sorted(grid):
            above = sum(s >= cutoff for s in scores)
            if above > seen or above > alpha * len(scores):
                continue  # the bound lies above the rate seen
            bound = binomial_upper(above, len(scores), level)
            if bound <= alpha:
                out[stratum] = (cutoff, bound, len(scores))
                break
    return out


SCORED = pa.schema([("seg_id", pa.int64()), ("stratum", pa.string()), ("words", pa.int64()), ("score", pa.float64()), ("content", pa.string())])
SCORED_DDL = "seg_id bigint, stratum string, words bigint, score double, content string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _score(floor: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("seg_id", "stratum", "content")]
            for seg, stratum, text in zip(*columns, strict=True):
                if len(text) <= 2 * STRETCH:
                    continue  # too short for six words of a letter and the blanks between them
                words = word_key(text)
                value = duplicate_share(words)
                if value >= floor:
                    out.append((seg, stratum, len(words), value, text))
            if out:
                yield _batch(out, SCORED)

    return score


def candidates(df: DataFrame, floor: float = SHARE) -> DataFrame:
    """Contents whose score reaches ``floor``, once per seg_id: seg_id, stratum, words, score, content.

    The score, the share of words seen before, is never below the share of repeated words; so no content under
    ``floor`` can have that share, and none is lost. All rows with a null seg_id count as one.
    """
    rows = df.where("content is not null").select("seg_id", F.lower(F.trim("segment_type")).alias("stratum"), "content")
    return cut(rows.mapInArrow(_score(floor), SCORED_DDL).dropDuplicates(["seg_id"]))


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [repeated_share(word_key(t)) for t in batch.column("content").to_pylist()]
        at = batch.schema.get_field_index("content")
        yield batch.remove_column(at).append_column("share", pa.array(shares, pa.float64()))


def with_share(found: DataFrame) -> DataFrame:
    """Candidates with the exact share of repeated words in place of their content."""
    kept = [c for c in found.columns if c != "content"]
    types = dict(found.dtypes)
    return found.select(*kept, "content").mapInArrow(_share, ", ".join(f"{c} {types[c]}" for c in kept) + ", share double")


def holdout(found: DataFrame, rows: int = HOLDOUT_ROWS, share: float = SHARE) -> list[tuple[str | None, float, bool]]:
    """Labels of about ``rows`` candidates drawn by a hash of their id: stratum, score, and is it repetitive.

    Candidates are texts that count once, so labels are independent. The draw depends on ids only, so a
    run on the same rows gives the same labels.
    """
    total = found.count()
    rate = min(1.0, rows / max(1, total))
    drawn = found.where(F.pmod(F.xxhash64("seg_id"), F.lit(1 << 30)) < rate * (1 << 30))
    return [(r.stratum, r.score, r.share >= share) for r in with_share(drawn).select("stratum", "score", "share").collect()]


def settled(found: DataFrame, cutoffs: dict[str | None, float]) -> DataFrame:
    """Candidates with their decision: rejected at or above their stratum's certified cutoff, else undecided."""
    cutoff = F.lit(math.inf)
    for stratum, value in cutoffs.items():
        cutoff = F.when(F.col("stratum").eqNullSafe(F.lit(stratum)), F.lit(float(value))).otherwise(cutoff)
    return found.withColumn("decision", F.when(F.col("score") >= cutoff, F.lit("rejected")).otherwise(F.lit("undecided")))


def repetitive(df: DataFrame, share: float = SHARE, cutoffs: dict[str | None, float] | None = None) -> DataFrame:
    """Contents with at least ``share`` repeated words: seg_id, stratum, score, decision, share.

    One pass scores all contents; those under ``share`` are clean for certain. Cutoffs are certified on a labelled
    holdout of the rest, per stratum, unless they are given. What scores at or above its cutoff is rejected
    by the score alone, its share is null, and the false-rejection rate among a stratum's clean candidates is bounded by
    ALPHA; what is undecided is measured. See :func:`risk` for what the cutoffs did.

    Needs seg_id, segment_type, content; other columns are ignored. Null contents and those of fewer than six words
    are no case; texts of any length are read whole; repeated deliveries give one row; an empty input gives none.
    """
    found = candidates(df, share)
    if cutoffs is None:
        cutoffs = {k: v[0] for k, v in choose_cutoffs(holdout(found, share=share)).items()}
    decided = settled(found, cutoffs)
    columns = ["seg_id", "stratum", "score", "decision"]
    rejected = decided.where("decision = 'rejected'").select(*columns, F.lit(None).cast("double").alias("share"))
    measured_rows = with_share(decided.where("decision = 'undecided'")).where(F.col("share") >= share).select(*columns, "share")
    return rejected.unionByName(measured_rows)


def risk(df: DataFrame, share: float = SHARE) -> DataFrame:
    """What the certified cutoffs do to all candidates of each stratum, with the false rejections counted exactly."""
    found = candidates(df, share)
    chosen = choose_cutoffs(holdout(found, share=share))
    measured_rows = with_share(settled(found, {k: v[0] for k, v in chosen.items()}))
    clean, rejected = F.col("share") < share, F.col("decision") == "rejected"
    counted = measured_rows.groupBy("stratum").agg(
        F.count_if(clean).alias("clean"),
        F.count_if(rejected).alias("rejected"),
        F.count_if(~rejected).alias("undecided"),
        F.count_if(rejected & clean).alias("wrongly_rejected"),
    )
    rows = [(k, float(v[0]), float(v[1])) for k, v in chosen.items()]
    bounds = df.sparkSession.createDataFrame(rows, "s string, cutoff double, bound double")
    joined = counted.join(F.broadcast(bounds), F.col("stratum").eqNullSafe(F.col("s")), "left")
    return joined.select("stratum", "cutoff", "bound", "clean", "rejected", "undecided", "wrongly_rejected")


MEASURED = pa.schema([("seg_id", pa.int64()), ("stratum", pa.string()), ("words", pa.int64()), ("score", pa.float64()), ("share", pa.float64())])
MEASURED_DDL = "seg_id bigint, stratum string, words bigint, score double, share double"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("seg_id", "stratum", "content")]
        for seg, stratum, text in zip(*columns, strict=True):
            words = word_key(text)
            out.append((seg, stratum, len(words), duplicate_share(words), repeated_share(words)))
        if out:
            yield _batch(out, MEASURED)


def measured(df: DataFrame) -> DataFrame:
    """Every content's words, score and exact share of repeated words, one row per seg_id.

    The same cases hold as in :func:`repetitive`, but texts with fewer than six words have a row, with share 0.
    """
    rows = df.where("content is not null").select("seg_id", F.lower(F.trim("segment_type")).alias("stratum"), "content")
    return rows.mapInArrow(_measure, MEASURED_DDL).dropDuplicates(["seg_id"])

"""Document fingerprints (operator 5): threshold-scaled sketch.

The fingerprint of a text holds every hash of its five-word shingles that lies below a fixed fraction of all hashes.
The same shingle is kept or left out in every text, so the sketch of a union is the union of sketches, and the share of
one sketch's hashes found in another estimates containment however unequal the texts are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import in_arrow, table, worker_value

WORDS = 5
# kept: hashes below 1 / 2**SCALE_BITS of their range
SCALE_BITS = 2


class Hashes(dict):
    """Word -> 64-bit hash, remembered for some hundred thousand words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: str, hashes: dict) -> np.ndarray:
    """Sorted distinct kept hashes of the shingles, as 32-bit numbers (their leading bits below the threshold).

    A text of fewer than five words is one shingle; a text without words has an empty sketch. A text none of whose
    hashes is kept gets its smallest one, in the same scale, so that no text with words is without a sketch.
    """
    parts = text.encode("utf-8", "replace").split()
    if not parts:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
    h = mixed(h)
    kept = h[h < np.uint64(1 << 64 - SCALE_BITS)]
    return np.unique((kept if len(kept) else h.min(keepdims=True)) >> np.uint64(32 - SCALE_BITS))


def spelled(kept: np.ndarray) -> str:
    """Fingerprint as text: eight hex digits for each kept hash."""
    return kept.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller in the larger; 1 for two empty sketches, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below a value, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    ends = F.array(*[F.lit(g[-1]) for g in groups[:-1]]) if len(groups) > 1 else None
    group = F.size(F.filter(ends, lambda b: b < value)) if ends is not None else F.lit(0)
    lists = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    return group * step + F.size(F.filter(F.element_at(lists, group + 1), lambda b: b < value))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, copy, pos, id, text): documents dealt into ranges of ids, each range followed by the next one's first row.

    Range borders come from quantiles of the ids, the first id of every range from one count; both are as many as
    there are ranges. Texts are shuffled once.
    """
    spark = docs.sparkSession
    pos = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), pos.alias("pos"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = chosen.select(F.col("pos").cast("double")).approxQuantile("pos", [k / parts for k in range(1, parts)], 0.2 / parts)
    placed = chosen.withColumn("bucket", _bucket(F.col("pos"), sorted({int(q) for q in quantiles})))
    firsts = dict(placed.groupBy("bucket").agg(F.min("pos")).collect())
    if not firsts:
        return placed.select("bucket", F.lit(0).alias("copy"), "pos", "id", "text")
    there = sorted(firsts)
    follows = {b: there[k - 1] for k, b in enumerate(there)}
    at = lambda values, default: F.element_at(F.array(*[F.lit(values.get(b, default)) for b in range(there[-1] + 1)]), F.col("bucket") + 1)
    own = F.struct(F.col("bucket"), F.lit(0).alias("copy"))
    also = F.struct(at(follows, 0).alias("bucket"), F.lit(1).alias("copy"))
    dealt = F.explode(F.when(F.col("pos") == at(firsts, 0), F.array(own, also)).otherwise(F.array(own)))
    return placed.select(dealt.alias("to"), "pos", "id", "text").select("to.bucket", "to.copy", "pos", "id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness, one row per document.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). In the edited text the last
    half is replaced by the start of the next document in ascending id order, the first following the last; a sole
    document follows itself. Null texts count as empty, null ids come first, rows of equal id follow each other in the
    order of their texts. Other columns are ignored; an empty table gives an empty result.
    """
    def rows(batches):
        hashes = worker_value(Hashes)
        run = last = None
        for columns in batches:
            for bucket, copy, _, i, text in zip(*columns):
                if bucket != run:
                    run, last = bucket, None
                if copy and last is None:
                    continue
                now = sketch(text, hashes)
                if last is not None:
                    key, before, held = last
                    half = len(before) // 2
                    edited = before[:len(before) - half] + text[:half]
                    kept = sketch(edited, hashes)
                    yield (
                        key, len(before), hashlib.sha256(edited.encode()).hexdigest(), spelled(held), spelled(kept),
                        likeness(held, kept), likeness(held, now),
                    )
                last = None if copy else (i, text, now)

    ordered = with_next(docs, id_col, text_col).repartition("bucket").sortWithinPartitions("bucket", "copy", "pos", "text")
    kind = dict(docs.dtypes)[id_col]
    return in_arrow(ordered, (
        f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    ), rows, flush=1000)


def op5_sketches(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))

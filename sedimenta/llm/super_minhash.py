"""MinHash near-dedup (operator 12): SuperMinHash signatures, banding, verification, union-find grouping.

Each element of a set owns a random permutation of the signature's slots; in round j it offers its j-th slot the value
j plus a random fraction, and a slot keeps the least offer of all elements. Offers of later rounds are larger than all
before, so a set is finished as soon as every slot has an offer: large sets need one or two rounds. Ranks inside
one permutation differ, which lowers the variance below that of independent minima. Sets that share a band of
five slots are compared in full, and links are joined to groups by alternating stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import in_columns, slices, table, words_of
from sedimenta.llm.linked_sets import linked, parity_sketch
from sedimenta.llm.sketches import mixed
from sedimenta.session import written

WORDS, PERCENT = 2, 80
# a pair with a similarity of 0.8 shares none of 32 bands of five slots with a chance of 3.1e-6
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
# bits of the filter that a second pass over the texts carries: 8 MB however large the corpus
FILTER_BITS = 1 << 26
_STEP, _FACTOR = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of slots for each non-empty set; ``hashes`` holds the sets' distinct elements one set after the other."""
    out = np.full((len(sizes), SLOTS), np.iinfo(np.uint64).max)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    swaps: list[np.ndarray] = []
    for j in range(SLOTS):
        if not len(owner):
            break
        drawn = mixed(hashes + np.uint64((j + 1) * _STEP % (1 << 64)))
        # the j-th swap of the permutation's shuffle, and what stands there after the swaps before
        place = (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.uint8) + np.uint8(j)
        slot = place
        for i in range(j - 1, -1, -1):
            slot = np.where(slot == swaps[i], np.uint8(i), slot)
        swaps.append(place)
        np.minimum.at(flat, owner * SLOTS + slot, np.uint64(j << 32) | (drawn >> np.uint64(32)))
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)[owner]
        if not open_.all():
            hashes, owner, swaps = hashes[open_], owner[open_], [s[open_] for s in swaps]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A number for each band and set; the band's place is part of it."""
    parts = mixed(signature + _FACTOR).reshape(len(signature), BANDS, ROWS)
    sums = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        sums = (sums + parts[:, :, k]) * _FACTOR
    return mixed(sums + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)


def bands_of(hashes: np.ndarray, sizes: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """Bands of non-empty sets, some thousand signatures in memory at a time."""
    ends = np.cumsum(sizes)
    return np.concatenate([np.zeros((0, BANDS), np.int64), *(
        bands(signatures(hashes[ends[k] - sizes[k]:ends[min(k + at_once, len(sizes)) - 1]], sizes[k:k + at_once])) for k in range(0, len(sizes), at_once)
    )])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of each text's word shingles one text after the other, sizes); A-Z in lower case.

    A text with fewer words than a shingle is one shingle; a text without words has an empty set.
    """
    import xxhash

    numbers, ends, names = words_of(pc.ascii_lower(texts))
    coded = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))[numbers] if len(names) else np.zeros(0, np.uint64)
    h, left = np.zeros(len(coded), np.uint64), np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(coded))
    for k in range(words):
        more = np.r_[coded[k:], np.zeros(min(k, len(coded)), np.uint64)]
        # a word that is not there counts nothing, so a short text's hash is of its whole sequence
        h = np.where(left > k, (h + more + np.uint64(1)) * _FACTOR, h)
    h, starts = mixed(h), np.r_[0, ends[:-1]].astype(np.int64)
    found = [np.unique(h[s:max(e - words + 1, s + 1)]) if e > s else h[:0] for s, e in zip(starts, ends)]
    return np.concatenate(found) if found else h[:0], np.array([len(f) for f in found], np.int64)


def _key(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes())


def described_sets(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, version, key, n, bands, sketch) of every text; key, bands and sketch are null for texts without words."""
    def columns(batches):
        # the larger part of a text's memory are its words' hashes, several times over
        for batch in (part for b in batches for part in slices(b, 2, 2_000_000)):
            found, sizes = shingle_sets(batch.column(2), words)
            some = sizes > 0
            ends = np.cumsum(sizes)
            parts = [found[e - n:e] for e, n in zip(ends, sizes) if n]
            rows = bands_of(found, sizes[some])
            of = np.where(some, np.cumsum(some) - 1, -1)
            take = pa.array(of, pa.int64(), mask=~some)
            keys = pa.array(np.array([_key(p) for p in parts], np.uint64).view(np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(rows.reshape(-1), pa.int64()))
            sketches = pa.array([parity_sketch(p) for p in parts], pa.binary())
            yield batch.column(0), batch.column(1), keys.take(take), sizes, lists.take(take), sketches.take(take)

    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col), F.xxhash64(text).alias("version"), text.alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return in_columns(chosen, f"`{id_col}` {kind}, version bigint, key bigint, n bigint, bands array<bigint>, sketch binary", columns)


def _bitmap(versions: DataFrame, bits: int) -> np.ndarray:
    """Bits of a fixed number, set where a version falls; collected as its non-empty parts of 4 KB."""
    at = F.pmod("version", F.lit(bits)) + 1
    parts = versions.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map")).collect()
    out, size = np.zeros(bits // 8, np.uint8), 4096
    for r in parts:
        # buckets of 32,768 positions begin at 1
        out[(r.part - 1) * size:r.part * size] = np.frombuffer(r["map"], np.uint8)[:len(out)]
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, text_col: str, bits: int = FILTER_BITS, words: int = WORDS):
    """Function from keys to (key, hashes): a second pass over the texts, of which a bitmap lets few through."""
    def of(keys: DataFrame) -> DataFrame:
        spark = docs.sparkSession
        bitmap = spark.sparkContext.broadcast(_bitmap(nodes.join(keys, "key", "left_semi").select("version"), bits))

        def columns(batches):
            seen = set()
            for batch in (part for b in batches for part in slices(b, 1, 2_000_000)):
                at = np.mod(batch.column(0).to_numpy(), bits)
                there = np.flatnonzero((bitmap.value[at >> 3] >> (at & 7)) & 1)
                # copies in one task are worked on once
                versions = batch.column(0).to_pylist()
                fresh = [k for k in dict(zip((versions[k] for k in reversed(there)), reversed(there.tolist()))).values() if versions[k] not in seen]
                if len(seen) > 100_000:
                    seen.clear()
                seen.update(versions[k] for k in fresh)
                if not fresh:
                    continue
                found, sizes = shingle_sets(batch.column(1).take(pa.array(fresh, pa.int64())), words)
                parts = [p for p in np.split(found, np.cumsum(sizes)[:-1]) if len(p)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()), pa.array(found.view(np.int64), pa.int64()))
                yield np.array([_key(p) for p in parts], np.uint64).view(np.int64), lists

        text = F.coalesce(F.col(text_col), F.lit(""))
        sets = in_columns(docs.select(F.xxhash64(text).alias("version"), text.alias("text")), "key bigint, hashes array<bigint>", columns)
        return sets.join(keys, "key", "left_semi").dropDuplicates(["key"])

    return of


def distinct_sets(each: DataFrame, id_col: str) -> DataFrame:
    """One row for each different set of ``described_sets``, with the smallest id that has it (``least``)."""
    return each.filter("key is not null").groupBy("key").agg(
        F.min(id_col).alias("least"), F.min("version").alias("version"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
    )


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept), linked at a Jaccard similarity of ``percent`` or more.

    A document's set are its distinct two-word shingles, A-Z in lower case, or its one word; ``component_id`` is the
    smallest id that can be reached over links, ``kept`` tells whether it is the row's own. Documents without words (null
    and empty texts too) have no shingles and are linked with nothing. Equal sets are one node however many documents
    have them. Repeated rows stay; a null id keeps its row, counts only if a group has no other id, and is kept only
    then. An empty table gives an empty result; other columns are ignored.
    """
    each = written(described_sets(docs, id_col, text_col), "minhash")
    nodes = written(distinct_sets(each, id_col), "minhash-nodes")
    roots = linked(nodes, sets_of(docs, nodes, text_col, filter_bits), percent, "minhash")
    placed = nodes.select("key", "least").join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    group_of = placed.join(least, "root").select("key", "component_id")
    found = each.select(id_col, "n", "key").join(group_of, "key", "left")
    own = F.when(F.col("key").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id")
    return found.select(id_col, F.col("n").alias("n_shingles"), own).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_sets(table(spark, sf_dir, "documents"))

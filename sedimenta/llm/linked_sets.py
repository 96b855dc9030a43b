"""Groups of similar sets from bands: pairs within bands are found by leaders, sifted by parity sketches, decided on whole sets.

A table of sets has one row per distinct set: its key, its size n, its bands (equal numbers bring sets together) and a
parity sketch. A bit of the sketch is 1 if an odd number of the set's hashes falls on it, so two sketches differ in at
most as many bits as two sets differ in elements. A pair whose sketches differ in more bits than the similarity allows
is therefore certainly not similar; no other pair is given up before its sets are compared in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import in_columns
from sedimenta.llm.components import components
from sedimenta.session import removed, scratch_path, written

# members in a block of a band; two blocks meet in one task
BLOCK = 1024


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the distinct hashes over a power of two of bits: at least 512 and twice the set's size, at most 65,536."""
    bits = min(max(512, 1 << (2 * len(hashes) - 1).bit_length()), 1 << 16) if len(hashes) else 512
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words brought to ``words`` words: parities add up, as a bit is a hash modulo a power of two."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def may_be_similar(a: bytes, n: int, rows: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets with sketches ``rows`` (64-bit words) and ``sizes`` can have a Jaccard similarity of ``percent`` with one set."""
    one = np.frombuffer(a, "<u8")[None, :]
    words = min(one.shape[1], rows.shape[1])
    differ = np.bitwise_count(_folded(rows, words) ^ _folded(one, words)).sum(axis=1, dtype=np.int64)
    # shared / union >= p with sizes' sum s and d different elements: (100 + p) d <= (100 - p) s
    fits = (100 + percent) * differ <= (100 - percent) * (sizes + n)
    return fits & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))


def _sifted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    def columns(batches):
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [k for k in range(len(a)) if may_be_similar(x[k], n[k], np.frombuffer(y[k], "<u8")[None, :], np.array([m[k]]), percent)[0]]
            yield [a[k] for k in keep], [b[k] for k in keep]

    one = nodes.select(F.col("key").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    two = nodes.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return in_columns(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y"), "a bigint, b bigint", columns)


def _block_pairs(count: Column, key: Column) -> Column:
    """Block pairs (i, j), i <= j, in which a member of a band with ``count`` members takes part, and its own block (i or j)."""
    blocks = F.ceil(count / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), own.alias("own")))


def _across_roots(percent: int):
    """Pairs of a band's members with different roots that their sketches allow; each group comes sorted and whole.

    A group of two blocks gives pairs across them only, and a pair that shares several bands is given by the first of them.
    """
    def pairs(band, two, own, root, key, n, sketch, bands):
        names, root = np.unique(root, return_inverse=True)
        if len(names) < 2:
            return
        rest = np.flatnonzero(root != np.bincount(root).argmax())
        done = np.zeros(len(root), bool)
        bands = np.array(bands)
        # members by length of their sketches, so that each length is one array
        length = np.array([len(s) for s in sketch])
        parts = [(p := np.flatnonzero(length == w), np.frombuffer(b"".join(sketch[k] for k in p), "<u8").reshape(len(p), -1)) for w in np.unique(length)]
        for k in rest:
            done[k] = True
            before = int(np.flatnonzero(bands[k] == band)[0])
            for at, rows in parts:
                # the members outside the largest root meet once
                other = (root[at] != root[k]) & ~done[at]
                if two:
                    other &= own[at] != own[k]
                if other.any():
                    chosen = at[other]
                    chosen = chosen[may_be_similar(sketch[k], int(n[k]), rows[other], n[chosen], percent)]
                    for o in chosen[~(bands[chosen, :before] == bands[k, :before]).any(axis=1)]:
                        yield int(key[k]), int(key[o])

    def columns(batches):
        held, last = None, None
        for batch in batches:
            ids = [c.to_numpy(zero_copy_only=False) for c in batch.select(["band", "i", "j"]).columns]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in ids])) + 1
            found = []
            for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if start == end:
                    continue
                name = tuple(int(c[start]) for c in ids)
                part = [c.slice(start, end - start) for c in batch.select(["own", "root", "key", "n", "sketch", "bands"]).columns]
                part = [*(c.to_numpy(zero_copy_only=False) for c in part[:4]), *(c.to_pylist() for c in part[4:])]
                if name == last:
                    held = [*(np.concatenate(x) for x in zip(held[:4], part[:4])), *(x + y for x, y in zip(held[4:], part[4:]))]
                else:
                    if held is not None:
                        found += pairs(last[0], last[1] != last[2], *held)
                    held, last = part, name
            if found:
                yield tuple(zip(*found))
        if held is not None and (found := list(pairs(last[0], last[1] != last[2], *held))):
            yield tuple(zip(*found))

    return columns


def linked(nodes: DataFrame, sets_of, percent: int, name: str, also: DataFrame | None = None) -> DataFrame:
    """(node, root): sets linked over pairs that share a band and have a Jaccard similarity of ``percent`` of a hundred or more.

    ``nodes``: (key, n, bands array, sketch) of distinct sets, written. ``sets_of(keys)`` gives (key, hashes) of some
    keys. First every member of a band meets the band's smallest member, so rows do not exceed members. Bands whose
    members then have several roots are looked at once more: members outside a block's largest root meet all others of
    their block pair that have another root, compared as arrays; only pairs that pass the sketches leave a task. A band
    with more than 1,024 members is dealt into blocks, and each pair of blocks is a group of its own. ``also``: further pairs (a, b), sifted and decided like those. Sets alone have no row.
    """
    spark = nodes.sparkSession
    owned: list[str] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        owned.append(scratch_path(spark, f"{name}-{what}"))
        return written(df, what, owned[-1])

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        pairs = kept(pairs.distinct(), f"{what}-pairs")
        keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        sets = kept(sets_of(keys), f"{what}-sets")
        x, y = F.col("x"), F.col("y")
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
        # shared >= p (x + y - shared) / 100 in whole numbers
        links = both.filter((100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y)))
        return kept(links.select("a", "b"), f"{what}-links")

    lists = nodes.select("key", F.explode("bands").alias("band"))
    crowded = lists.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("members")).filter("members > 1")
    members = kept(lists.join(crowded, "band"), "members")
    first = members.filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    if also is not None:
        first = first.unionByName(also.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()
    links = verified(_sifted(first, nodes, percent), "first")
    roots = components(links, f"{name}-part")

    placed = members.join(roots, members["key"] == roots["node"], "left").select("band", "key", "members", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    split = placed.join(mixed, "band", "left_semi").select("band", "key", "root", F.explode(_block_pairs(F.col("members"), F.col("key"))).alias("to"))
    dealt = split.select("band", "to.i", "to.j", "to.own", "root", "key").join(nodes.select("key", "n", "sketch", "bands"), "key").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    across = in_columns(dealt.select("band", "i", "j", "own", "root", "key", "n", "sketch", "bands"), "a bigint, b bigint", _across_roots(percent))
    more = verified(across.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "second")
    out = components(links.unionByName(more), f"{name}-components")
    for path in owned:
        removed(spark, path)
    return out

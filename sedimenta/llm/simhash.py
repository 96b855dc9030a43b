"""SimHash near-dedup (operator 1): byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share at
least four positional bytes. The index has one posting for every choice of four byte positions and the bytes there:
two fingerprints meet in a posting list exactly if their tally of shared positional bytes reaches that minimum. The
bits are compared then.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import in_arrow, in_columns, table
from sedimenta.llm.components import components
from sedimenta.llm.similar import similar_documents
from sedimenta.session import written

BITS = 4
POSITIONS = list(combinations(range(8), 8 - BITS))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


MASKS = [_signed(sum(0xFF << 8 * p for p in chosen)) for chosen in POSITIONS]
FLIPS = [_signed(sum(1 << b for b in chosen)) for k in range(BITS // 2 + 1) for chosen in combinations(range(64), k)]


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, A-Z in lower case; zero without words.

    A bit is set if more than half of the XXH64 values of the shingles, repeats included, have it.
    """
    import xxhash

    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(len(parts) - words + 1, 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    last = ends[-n:].tolist()
    for k in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[k:k + (1 << 16)], last[k:k + (1 << 16)])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as a signed number) of every whole text; null texts as empty."""
    def rows(batches):
        for ids, texts in batches:
            for i, text in zip(ids, texts):
                yield i, fingerprint(text)

    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_arrow(chosen, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint bigint", rows)


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of signed numbers, the sign bit included."""
    return np.bitwise_count(x.view(np.uint64))


def _groups(members: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest member) within each linked group of distinct sorted fingerprints, by search from the smallest."""
    out, rest = [], members
    while len(rest):
        root, frontier, rest = int(rest[0]), rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            for f in frontier:
                near |= _bits(rest ^ f) <= BITS
            frontier, rest = rest[near], rest[~near]
            out += [(int(m), root) for m in frontier]
    return out


def _runs(batches, run_length: int = 1 << 16):
    """Arrays (key columns..., fingerprint) whose runs of equal keys are whole, and whether they are part of a long run.

    A run is held until its end comes. One of more than ``run_length`` rows is passed on in parts, each told to be long up
    to the key's change and each with the run's first row in front.
    """
    held, long = None, False
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        if long:
            other = np.logical_or.reduce([c != c[0] for c in now[:-1]])
            lead = int(np.argmax(other)) if other.any() else len(other)
            if lead > 1:
                yield [c[:lead] for c in now], True
            if lead == len(other):
                held = [c[:1] for c in now]
                continue
            now, long = [c[lead:] for c in now], False
        same = np.logical_and.reduce([c == c[-1] for c in now[:-1]])
        cut = len(same) - np.argmin(same[::-1]) if not same.all() else 0
        if cut:
            yield [c[:cut] for c in now], False
        held = [c[cut:] for c in now]
        if len(held[0]) > run_length:
            yield held, True
            held, long = [c[:1] for c in held], True
    if held is not None and len(held[0]) and not long:
        yield held, False


def _from_postings(long_list: int, run_length: int = 1 << 16):
    """Links within posting lists: (a, b); members of lists longer than ``long_list`` or ``run_length``: (a, null)."""
    def columns(batches):
        for (choice, key, prints), long in _runs(batches, run_length):
            if long:
                yield prints, [None] * len(prints)
                continue
            first = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
            size = np.diff(np.r_[first, len(key)])
            two = first[size == 2]
            near = two[_bits(prints[two] ^ prints[two + 1]) <= BITS]
            # one output batch, however many lists there are
            a, b = [prints[near + 1]], [prints[near]]
            crowded = np.repeat(size > long_list, size)
            for f, n in zip(first[(size > 2) & (size <= long_list)].tolist(), size[(size > 2) & (size <= long_list)].tolist()):
                if found := _groups(prints[f:f + n]):
                    members, roots = np.array(found, "<i8").T
                    a.append(members)
                    b.append(roots)
            yield np.concatenate(a), np.concatenate(b)
            if crowded.any():
                yield prints[crowded], [None] * int(crowded.sum())

    return columns


def _from_middles(batches):
    """Fingerprints that share a middle, linked to the smallest of them."""
    for (middles, prints), _ in _runs(batches):
        first = np.flatnonzero(np.r_[True, middles[1:] != middles[:-1]])
        least = np.repeat(prints[first], np.diff(np.r_[first, len(prints)]))
        linked = prints != least
        yield prints[linked], least[linked]


def links(prints: DataFrame, long_list: int = 4096) -> DataFrame:
    """(a, b): links that join the same fingerprints into the same groups as all pairs of at most four differing bits.

    ``prints``: distinct ``fingerprint``. Posting lists of up to ``long_list`` are compared inside and give one link
    per linked member. Members of longer lists are linked by middles instead: two fingerprints differ in at most four
    bits exactly if some number differs from both in at most two, so all that reach the same number belong together.
    That costs a fixed 2,081 rows per such member, and no list is ever compared with itself.
    """
    choices = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(MASKS)]))
    postings = prints.select("fingerprint", choices.alias("p")).select("p.c", "p.k", "fingerprint")
    sorted_lists = postings.repartition("c", "k").sortWithinPartitions("c", "k", "fingerprint")
    found = written(in_columns(sorted_lists, "a bigint, b bigint", _from_postings(long_list)), "simhash-links")
    crowded = found.filter("b is null").select("a").distinct()
    flips = F.explode(F.array(*[F.lit(f) for f in FLIPS]))
    middles = crowded.select("a", flips.alias("f")).select(F.col("a").bitwiseXOR(F.col("f")).alias("m"), "a")
    by_middle = in_columns(middles.repartition("m").sortWithinPartitions("m", "a"), "a bigint, b bigint", _from_middles)
    return found.filter("b is not null").unionByName(by_middle).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = 4096) -> DataFrame:
    """One row per document: (id, fingerprint as 16 hex digits, component_id).

    Documents whose fingerprints differ in at most four bits are linked; ``component_id`` is the smallest id that can
    be reached over links. Equal fingerprints are one node however many documents have them. Texts without words (null
    and empty ones too) have fingerprint zero and are linked like any other. Repeated rows stay; a null id keeps its
    row and counts only if a component has no other id. An empty table gives an empty result; other columns are ignored.
    """
    each = written(fingerprints(docs, id_col, text_col), "simhash")
    nodes = each.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    roots = components(links(nodes.select("fingerprint"), long_list), "simhash-components")
    placed = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    group_of = placed.join(least, "root").select("fingerprint", "component_id")
    return each.join(group_of, "fingerprint").select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def fingerprint_pairs(docs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b): keys of sets whose texts' fingerprints are linked in the index. ``nodes``: (key, version) of distinct sets.

    Of sets with one fingerprint each meets the smallest, and these meet over the links between fingerprints.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = fingerprints(docs.select(F.xxhash64(text).alias("version"), text.alias("text")), "version").distinct()
    of = written(nodes.select("key", "version").join(prints, "version").select("key", "fingerprint"), "similar-prints")
    least = written(of.groupBy("fingerprint").agg(F.min("key").alias("least")), "similar-least")
    same = of.join(least, "fingerprint").filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    one, two = least.toDF("a", "_a"), least.toDF("b", "_b")
    near = links(least.select("fingerprint")).join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(near)


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near-duplicates one document stays, with all columns.

    Near-duplicates are those of ``similar``: five-word shingles, similarity 0.8 or more. Pairs come from the index of
    fingerprints and, as similar texts may differ in more than four bits, from bands too; shingles decide. The document with the smallest
    id stays, of texts with that id the one with the smallest hash; null ids come last. Of repeated rows with that id and
    text all stay, without an id one.
    """
    row = F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"))
    keyed = docs.select(F.struct("*").alias("doc"), row.alias("_row"), "text")
    groups = similar_documents(keyed, "_row", "text", fingerprint_pairs).filter(F.col("_row").eqNullSafe(F.col("component_id")))
    keep = written(groups.select(F.col("_row.id").alias("keep_id"), F.col("_row.version").alias("keep_version")).distinct(), "similar-kept")
    same = F.col("_row.id").eqNullSafe(F.col("keep_id")) & (F.col("_row.version") == F.col("keep_version"))
    kept = keyed.join(keep, same, "left_semi")
    lost = kept.filter("_row.lost").dropDuplicates(["_row"])
    return kept.filter("not _row.lost").unionByName(lost).select("doc.*")

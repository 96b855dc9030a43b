"""Substring dedup (operator 7): compressed FM-index per shard.

Repeated passages are found in three steps. Every window of 20 words is anchored at its smallest five-word gram, and
neighbouring windows of one anchor form a run. Anchors that occur once cannot belong to a repeated window; the runs of
all others are dealt into shards by their anchor, so equal windows meet. In each shard the runs are indexed, their
windows are streamed against the index by backward search, and those that occur earlier too are reported as intervals.

The symbols of the index are five-word grams: a sequence of words is indexed once for every phase, as every fifth gram
from each of its first five, so a window is four symbols of one phase.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import in_arrow, in_columns, released, slices, table, words_of, worker_value
from sedimenta.llm.fm_index import Index
from sedimenta.llm.sketches import Hashes, mixed
from sedimenta.session import written

WINDOW, GRAM = 20, 5
DEPTH = WINDOW // GRAM
# places of a window's grams
GRAMS = WINDOW - GRAM + 1


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hashes of the five-word grams of all texts, one after another, and where each text's words end.

    The gram of a word is at the word's place; grams over the end of a text mean nothing.
    """
    index, ends, names = words_of(texts)
    hashes = worker_value(Hashes)
    words = np.fromiter((hashes[n.encode()] for n in names), np.uint64, len(names))[index]
    words = np.r_[words, np.zeros(GRAM - 1, np.uint64)]
    h = np.zeros(len(index), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(h)]
    return mixed(h).view(np.int64), ends


def _anchors(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor's hash, first window, windows)."""
    windows = len(grams) - GRAMS + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 3
    least = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(grams, GRAMS).argmin(axis=1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return grams[least[first]], first, np.diff(np.r_[first, windows])


def _anchor_columns(batches):
    for batch in batches:
        for doc, nth, texts in (part.columns for part in slices(batch, 2)):
            grams, ends = _grams(texts)
            found = [_anchors(grams[b:max(e - GRAM + 1, b)]) for b, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
            per_text = np.array([len(f[0]) for f in found])
            owner = np.repeat(np.arange(len(found)), per_text)
            anchor, first, n = (np.concatenate(c) for c in zip(*found))
            yield anchor, doc.to_numpy()[owner], nth.to_numpy()[owner], first, n


def _repeated(hot: int):
    """Rows sorted by anchor whose anchor has another row; ``hot`` tells that it has more than that many."""
    def columns(batches):
        held: list[np.ndarray] = []

        def out(cols, many):
            _, doc, nth, first, n = cols
            return doc, nth, first, n, np.full(len(doc), many)

        long = False
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            begin = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
            size = np.diff(np.r_[begin, len(now[0])])
            if long:
                # what goes on from a run already told to be hot
                yield out([c[1:size[0]] for c in now], True)
                if len(begin) == 1:
                    held = [c[-1:] for c in now]
                    continue
                now = [c[size[0]:] for c in now]
                begin, size, long = begin[1:] - size[0], size[1:], False
            whole, last = np.repeat(size, size), begin[-1]
            done = np.arange(len(whole)) < last
            yield out([c[done & (whole > 1) & (whole <= hot)] for c in now], False)
            yield out([c[done & (whole > hot)] for c in now], True)
            held = [c[last:] for c in now]
            if len(held[0]) > hot:
                yield out(held, True)
                held, long = [c[-1:] for c in held], True
        if held and not long and len(held[0]) > 1:
            yield out(held, False)

    return columns


def _gathered(grams: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after another."""
    return grams[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]


def _binary(grams: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(length * 8)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(grams))])


def _shard_columns(shards: int):
    """(shard, stride, grams, doc, nth, at, n) of the runs of documents.

    Runs of hot anchors go window by window, each to a shard by its own content. Of equal hot windows of one document
    only the first is sent; the others start later for certain and are marked by stride 0.
    """
    def columns(batches):
        for batch in batches:
            for part in slices(batch, 2):
                doc, nth, texts, runs = part.columns
                doc, nth = doc.to_numpy(), nth.to_numpy()
                grams, ends = _grams(texts)
                begins = np.r_[0, ends[:-1]]
                owner = np.repeat(np.arange(len(part)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                each = runs.flatten()
                at, n, hot = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                start = begins[owner] + at
                least = grams.copy()
                for k in range(1, GRAMS):
                    np.minimum(least[:-k], grams[k:], out=least[:-k])
                few = hot == 0
                length = n[few] + GRAMS - 1
                yield (
                    least[start[few]] % shards, np.full(len(length), GRAM), _binary(_gathered(grams, start[few], length), length),
                    doc[owner[few]], nth[owner[few]], at[few], n[few],
                )
                many = np.repeat(np.flatnonzero(hot), n[hot == 1])
                if not len(many):
                    continue
                inside = _gathered(np.arange(int(n.max())), np.zeros(int(hot.sum()), np.int64), n[hot == 1])
                place, who = at[many] + inside, owner[many]
                windows = grams[(start[many] + inside)[:, None] + GRAM * np.arange(DEPTH)]
                order = np.lexsort((place, *windows.T, who))
                place, who, windows = place[order], who[order], windows[order]
                again = np.r_[False, (who[1:] == who[:-1]) & (windows[1:] == windows[:-1]).all(axis=1)]
                shard = np.where(again, who, mixed(windows.view(np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)) % shards
                length = np.where(again, 0, DEPTH)
                yield (
                    shard, np.where(again, 0, 1), _binary(windows[~again].reshape(-1), length), doc[who], nth[who], place,
                    np.ones(len(who), np.int64),
                )

    return columns


def _searched(batches):
    """(doc, nth, at, n): windows of shard rows that also start earlier, as intervals of windows.

    Rows come sorted by shard, stride, content and place. Rows of equal content are one sequence of the index, with the
    first one's place; the windows of the others all start earlier there. A row with the same place as well is a
    repeated row of the table and not earlier.
    """
    held: list[tuple] = []
    shard, first = None, None
    for batch in batches:
        raw = batch.column(2)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64) // 8
        grams = np.frombuffer(raw.buffers()[2] or b"", "<i8")[offsets[0]:offsets[-1]] if offsets[-1] else np.zeros(0, np.int64)
        size = np.diff(offsets)
        number, stride, doc, nth, at, n = (batch.column(k).to_numpy() for k in (0, 1, 3, 4, 5, 6))
        # equal to the row before: the same shard, stride, length and grams
        begin = offsets[:-1] - offsets[0]
        same = np.r_[False, (number[1:] == number[:-1]) & (stride[1:] == stride[:-1]) & (size[1:] == size[:-1])] & (stride > 0)
        rows = np.flatnonzero(same)
        if len(rows):
            equal = _gathered(grams, begin[rows], size[rows]) == _gathered(grams, begin[rows - 1], size[rows])
            same[rows] = np.logical_and.reduceat(equal, np.cumsum(size[rows]) - size[rows])
        if first is not None and stride[0] and (number[0], stride[0], size[0]) == first[:3]:
            same[0] = (grams[:size[0]] == first[3]).all()
        leader = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
        places = np.c_[doc, nth, at]
        moved = np.where(leader[:, None] < 0, first[4] if first is not None else 0, places[leader]) != places
        gone = (stride == 0) | same & moved.any(axis=1)
        yield doc[gone], nth[gone], at[gone], n[gone]
        kept = np.flatnonzero(~same & (stride > 0))
        for rows in np.split(kept, np.flatnonzero(np.diff(number[kept])) + 1):
            if not len(rows):
                continue
            if number[rows[0]] != shard:
                yield from _from_index(held)
                held, shard = [], number[rows[0]]
            held.append((_gathered(grams, begin[rows], size[rows]), size[rows], stride[rows], doc[rows], nth[rows], at[rows]))
        if leader[-1] >= 0:
            k = leader[-1]
            first = (number[k], stride[k], size[k], grams[begin[k]:begin[k] + size[k]].copy(), places[k])
    yield from _from_index(held)


def _from_index(held: list[tuple]):
    """Index the sequences of one shard, stream their windows against it, and give the intervals above the threshold."""
    if not held:
        return
    grams, sizes, strides, doc, nth, at = (np.concatenate(c) for c in zip(*held))
    # in order of place, so that the smaller number of a window starts earlier
    order = np.lexsort((at, nth, doc))
    grams = _gathered(grams, (np.cumsum(sizes) - sizes)[order], sizes[order])
    sizes, strides, doc, nth, at = (c[order] for c in (sizes, strides, doc, nth, at))
    windows = sizes - (DEPTH - 1) * strides
    base = np.cumsum(windows) - windows
    seq = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[seq]
    phase = place % strides[seq]
    none = np.iinfo(np.int64).max
    order = np.where(place < windows[seq], base[seq] + place, none)
    _, numbers = np.unique(grams, return_inverse=True)
    # one stretch of text for every phase of every sequence, closed by 0
    by_phase = np.lexsort((place, phase, seq))
    ends = np.r_[np.flatnonzero(np.diff(seq[by_phase] * GRAM + phase[by_phase])) + 1, len(grams)]
    text, order = np.insert(numbers[by_phase] + 1, ends, 0), np.insert(order[by_phase], ends, none)
    index, begins, hits = Index(text, order, DEPTH), np.flatnonzero(order < none), []
    for k in range(0, len(begins), 1 << 17):
        some = begins[k:k + (1 << 17)]
        matched, least = index.matching(text[some[:, None] + np.arange(DEPTH)])
        hits.append(order[some[(matched == DEPTH) & (least < order[some])]])
    hit = np.sort(np.concatenate(hits))
    owner = np.searchsorted(base, hit, side="right") - 1
    start = hit - base[owner]
    new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(start) != 1)]) if len(hit) else hit
    who = owner[new]
    yield doc[who], nth[who], at[who] + start[new], np.diff(np.r_[new, len(hit)])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, nth, text): key is the id or the smallest number, nth tells texts of one id apart by a hash of theirs."""
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))
    hashed = chosen.select("key", F.xxhash64("text").alias("hash"))
    shared = hashed.groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).filter("a <> b").select("key")
    if shared.isEmpty():
        return chosen.withColumn("nth", F.lit(0))
    ranked = hashed.join(shared, "key", "left_semi").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("hash")))
    return chosen.withColumn("hash", F.xxhash64("text")).join(ranked, ["key", "hash"], "left").select("id", "key", F.coalesce("nth", F.lit(0)).alias("nth"), "text")


def repeated_windows(texts: DataFrame, hot: int = 20_000, shard_windows: int = 200_000) -> DataFrame:
    """(key, nth, at, n) from (key, nth, text): every interval of windows that also start earlier.

    Earlier: smaller key, then smaller nth, then earlier start. Runs of an anchor with more than ``hot`` rows are dealt
    window by window over all shards, as four symbols each. The number of shards follows the number of windows kept.
    """
    spark = texts.sparkSession
    kept = written(_repeated_runs(texts, hot), "substring-runs")
    released(spark)
    windows = kept.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(windows / shard_windows))
    out = written(_shard_search(texts, kept, shards), "substring-repeats")
    released(spark)
    return out


def _repeated_runs(texts: DataFrame, hot: int) -> DataFrame:
    anchors = in_columns(texts.select("key", "nth", "text"), "anchor bigint, key bigint, nth int, at int, n int", _anchor_columns)
    return in_columns(anchors.repartition("anchor").sortWithinPartitions("anchor"), "key bigint, nth int, at int, n int, hot boolean", _repeated(hot))


def _shard_search(texts: DataFrame, runs: DataFrame, shards: int) -> DataFrame:
    lists = runs.groupBy("key", "nth").agg(F.collect_list(F.struct("at", "n", "hot")).alias("runs"))
    found = texts.select("key", "nth", "text").join(lists, ["key", "nth"])
    dealt = in_columns(found, "shard int, stride int, grams binary, key bigint, nth int, at int, n int", _shard_columns(shards))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "stride", "grams", "key", "nth", "at")
    return in_columns(dealt, "key bigint, nth int, at int, n int", _searched)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 20_000, shard_windows: int = 200_000) -> DataFrame:
    """(id, n_words, n_removed, kept) of every whole text: words covered by a window of 20 that starts earlier too go.

    Words stand between ASCII white space; the kept ones are joined by one space. Windows are judged on the input. Null
    and empty texts have no words, texts of fewer than 20 words lose none. Null ids come first; different texts of one
    id are ordered by their hashes, and repeated rows (same id and text) count once and give equal rows. Other columns
    are ignored.
    """
    texts = _numbered(docs, id_col, text_col)
    repeats = repeated_windows(texts, hot, shard_windows)
    lists = repeats.groupBy("key", "nth").agg(F.collect_list(F.struct("at", "n")).alias("gone"))

    def rows(batches):
        for ids, texts_, lists_ in batches:
            for i, text, gone in zip(ids, texts_, lists_):
                words = text.encode("utf-8", "surrogatepass").split()
                keep = np.ones(len(words), bool)
                for run in gone or ():
                    keep[run["at"]:run["at"] + run["n"] + WINDOW - 1] = False
                kept = [words[k] for k in np.flatnonzero(keep)] if gone else words
                yield i, len(words), len(words) - len(kept), b" ".join(kept).decode()

    joined = texts.join(lists, ["key", "nth"], "left").select("id", "text", "gone")
    return in_arrow(joined, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words bigint, n_removed bigint, kept string", rows, flush=500)


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

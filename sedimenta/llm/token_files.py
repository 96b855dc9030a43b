"""Token-ID files (operator 3): frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A token file is a Parquet folder, written and committed by Spark, with one row per block of whole documents in
ascending id order. Within a block the ids of all documents follow each other. Each id is replaced by its rank among
all ids of the corpus (0: the most frequent), stored in 1 to 4 little-endian bytes in ``data``; the 2-bit length codes
of four ids at a time make one byte of ``control``. A folder ``ranks`` beside the blocks lists the id of every rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.bpe import Encoder
from sedimenta.llm.common import in_arrow, in_columns, slices, table, vocabulary, worker_value
from sedimenta.session import scratch_path, written

BLOCK = "shard int, block int, first bigint, {id} array<{kind}>, lengths array<int>, control binary, data binary"


def control_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every control byte: bytes taken by its four numbers, and where each of the 16 result bytes comes from (-1: zero)."""
    lengths = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
    starts = np.cumsum(lengths, axis=1) - lengths
    inside = np.arange(4)[None, None, :]
    source = np.where(inside < lengths[:, :, None], starts[:, :, None] + inside, -1).reshape(256, 16)
    return lengths.sum(axis=1), source


def packed(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers; the last group of four is filled up with zeros."""
    filled = np.zeros(-(-len(numbers) // 4) * 4, "<u4")
    filled[:len(numbers)] = numbers
    code = (filled > 0xFF).astype(np.uint8) + (filled > 0xFFFF) + (filled > 0xFFFFFF)
    control = code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    kept = np.arange(4) <= code[:, None]
    return control.sum(axis=1).astype(np.uint8).tobytes(), filled.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpacked(control: bytes, data: bytes, count: int, step: int = 1 << 16) -> np.ndarray:
    """The numbers again: one table lookup per control byte tells which data byte goes where."""
    total, source = control_tables()
    codes, stream = np.frombuffer(control, np.uint8), np.frombuffer(data + b"\0", np.uint8)
    out, at = np.empty(len(codes) * 4, "<u4"), 0
    for k in range(0, len(codes), step):
        part = codes[k:k + step]
        used = total[part]
        begin = at + np.cumsum(used) - used
        where = source[part]
        place = np.where(where < 0, len(data), begin[:, None] + where)
        out[4 * k:4 * (k + len(part))] = stream[place].view("<u4").reshape(-1)
        at += int(used.sum())
    return out[:count]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(id, n, ids): ids of each text with the end id, as compressed byte planes; and one (counts) row per partition."""
    import zstandard

    def columns(batches):
        encoder, squeeze = worker_value(Encoder, tokenizer), zstandard.ZstdCompressor(level=1)
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for keys, texts in (part.columns for part in slices(batch, 1)):
                flat, ends = encoder.encode_all(texts)
                lengths = np.diff(ends, prepend=0)
                flat = np.insert(flat, ends, end_id)
                counts = np.bincount(flat)
                if len(counts) > len(seen):
                    seen = np.pad(seen, (0, len(counts) - len(seen)))
                seen[:len(counts)] += counts
                each = np.split(flat, np.cumsum(lengths + 1)[:-1])
                planes = [squeeze.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes()) for ids in each]
                yield keys, lengths + 1, planes, [None] * len(keys)
        used = np.flatnonzero(seen)
        yield [None], [None], [None], [used.astype("<i8").tobytes() + seen[used].astype("<i8").tobytes()]

    kind = docs.schema[0].dataType.simpleString()
    return in_columns(docs, f"id {kind}, n int, ids binary, counts binary", columns)


def ranked_ids(counts: DataFrame) -> list[int]:
    """All ids by falling frequency, ties by id. As many rows as the vocabulary has entries, however large the corpus."""
    def rows(batches):
        for (packs,) in batches:
            for pack in packs:
                used, n = np.frombuffer(pack, "<i8").reshape(2, -1)
                yield from zip(used.tolist(), n.tolist())

    found = in_arrow(counts.select("counts"), "id bigint, n bigint", rows).groupBy("id").agg(F.sum("n").alias("n"))
    return [r[0] for r in sorted(found.collect(), key=lambda r: (-r[1], r[0]))]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int = 1 << 18,
) -> None:
    """Write the token file of all whole texts under ``path``, in ascending id order.

    A null text has only the end id. Rows of equal id all stay, ordered by their content; null ids come first.
    An empty table gives an empty file. Other columns are ignored. Only the rank list (vocabulary size) passes the
    driver; texts are encoded once, into a table on the shared folder, and sorted over range partitions.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded = written(_encoded(chosen, tokenizer, end_id), "token-ids")
    ranking = ranked_ids(encoded.filter("counts is not null"))
    spark.createDataFrame([(r, i) for r, i in enumerate(ranking)], "rank int, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ranking, default=0) + 1, "<u4")
    rank_of[ranking] = np.arange(len(ranking), dtype="<u4")

    def rows(batches):
        import zstandard

        shard, unsqueeze = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        block, first, keys, held, lengths = 0, 0, [], [], []

        def closed():
            return (shard, block, first, list(keys), list(lengths), *packed(np.concatenate(held)))

        for ids, _, planes in batches:
            for key, pack in zip(ids, planes):
                raw = np.frombuffer(unsqueeze.decompress(pack), np.uint8).reshape(4, -1)
                keys.append(key)
                held.append(rank_of[np.ascontiguousarray(raw.T).view("<u4").reshape(-1)])
                lengths.append(len(held[-1]))
                if sum(lengths) >= block_tokens:
                    yield closed()
                    block, first = block + 1, first + sum(lengths)
                    keys, held, lengths = [], [], []
        if keys:
            yield closed()

    kind = chosen.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.filter("ids is not null").select("id", "n", "ids").repartitionByRange(parts, "id").sortWithinPartitions("id", "ids")
    in_arrow(ordered, BLOCK.format(id="ids", kind=kind), rows, flush=8).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, rows_of=None, columns: str = "n_tokens bigint, ids array<bigint>") -> DataFrame:
    """Documents of a token file: (id, start, ...), ``start`` being the ids of all documents before it.

    ``rows_of(ids) -> tuple`` turns a document's ids (numpy) into the values of ``columns``; by default their number
    and the ids themselves.
    """
    rows_of = rows_of or (lambda ids: (len(ids), ids.tolist()))
    blocks = spark.read.parquet(f"{path}/blocks")
    ranking = np.array([r[0] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], "<u4")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    # one number per range partition
    totals = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)"))).collect()
    offsets, so_far = {}, 0
    for shard, total in sorted(totals):
        offsets[shard], so_far = so_far, so_far + total

    def rows(batches) -> Iterator[tuple]:
        for columns_ in batches:
            for shard, first, keys, lengths, control, data in zip(*columns_):
                ids = ranking[unpacked(control, data, sum(lengths))]
                at = 0
                for key, n in zip(keys, lengths):
                    yield key, offsets[shard] + first + at, *rows_of(ids[at:at + n])
                    at += n

    placed = blocks.select("shard", "first", "ids", "lengths", "control", "data")
    return in_arrow(placed, f"id {kind}, start bigint, {columns}", rows, flush=500)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through a token file and back, as (doc_id, start, n_tokens, ids_crc32)."""
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    digest = lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    found = read_token_files(spark, path, digest, "n_tokens bigint, ids_crc32 bigint")
    return found.withColumnRenamed("id", "doc_id")

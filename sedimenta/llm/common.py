"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_arrow(df: DataFrame, schema: str, rows: Callable[[Iterable], Iterable[tuple]], flush: int = 4000) -> DataFrame:
    """``rows`` turns one partition's stream of record lists into output tuples, sent on in Arrow batches.

    ``rows`` gets the columns of some rows at a time as Python lists, so at most one incoming batch and ``flush``
    output rows are held. The output columns and types are those of ``schema``.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in held], f.type) for i, f in enumerate(kind)], schema=kind
            )
            held.clear()
            return out

        # a few hundred rows at a time become Python objects
        parts = (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500))
        for row in rows([c.to_pylist() for c in p.columns] for p in parts):
            held.append(row)
            if len(held) >= flush:
                yield sent()
        if held:
            yield sent()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def in_columns(df: DataFrame, schema: str, columns: Callable[[Iterable], Iterable[tuple]]) -> DataFrame:
    """Like ``in_arrow`` with whole columns: ``columns`` gets the Arrow batches and yields tuples of equally
    long arrays or lists, each tuple one output batch."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in columns(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


class Remembered:
    """Values by name in two generations: names not asked for since the last generation began are forgotten.

    A generation ends with more than ``keep`` names, or with names and values of more than ``size`` characters and bytes.
    """

    def __init__(self, keep: int, size: int):
        self._keep, self._size, self._held, self._now, self._old = keep, size, 0, {}, {}

    def all(self, names: list, learn: Callable[[list], Iterable[tuple]]) -> list:
        """Values of all names; ``learn`` gives the (name, value) pairs of those not remembered."""
        if len(self._now) > self._keep or self._held > self._size:
            self._now, self._old, self._held = {}, self._now, 0
        now, old, unknown, before = self._now, self._old, [], len(self._now)
        for n in names:
            if n not in now:
                value = old.pop(n, None)
                if value is None:
                    unknown.append(n)
                else:
                    now[n] = value
        if unknown:
            now.update(learn(unknown))
        self._held += sum(len(n) + len(v) for n, v in islice(now.items(), before, None))
        return list(map(now.__getitem__, names))


def slices(batch: pa.RecordBatch, text: int, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``chars`` bytes in its text column, single rows of more by themselves."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(int(np.searchsorted(size, base + chars, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: (number of each word, where each text's words end, distinct words by number)."""
    lists = pc.ascii_split_whitespace(texts)
    words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    coded = words.filter(pa.array(some)).dictionary_encode()
    return coded.indices.to_numpy(), np.cumsum(np.bincount(owner[some], minlength=len(lists))), coded.dictionary.to_pylist()


def released(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps now, not at the driver's next collection of garbage.

    The driver's handles go with Python's, and the shuffles with the handles, so this takes two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@lru_cache(maxsize=2)
def worker_value(make: Callable, *args):
    """A costly object that a Python worker builds once and keeps between tasks."""
    return make(*args)

"""Token counts (operator 10): overlap resynchronisation of huge documents."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bpe import CUT, Encoder
from sedimenta.llm.common import in_columns, slices, table, vocabulary, worker_value


def count_by_overlap(library, text: str, size: int = 32_768, overlap: int = 256) -> int:
    """Tokens of a huge text from overlapping chunks, with never more than a chunk's tokens in memory.

    Chunk and next chunk share ``overlap`` characters. Both encodings are compared by their offsets there: a splice is
    a token start of both, at a space that a non-space follows. At such a place the pattern starts a pre-token whatever
    stands before, and the chunk's end is behind it, so the tokens to the left are right in the first chunk and those
    to the right in the second. Without a splice the overlap is doubled, and once it fills the chunk, the chunk is.
    """
    counted, start = 0, 0
    while True:
        end = min(start + size, len(text))
        tokens = library.encode(text[start:end], add_special_tokens=False)
        if end == len(text):
            return counted + len(tokens.ids)
        starts = {start + s: i for i, (s, _) in reversed(list(enumerate(tokens.offsets)))}
        shared = overlap
        while True:
            shared = min(shared, end - start - 1)
            places = [p + end - shared for p in (m.start() for m in CUT.finditer(text[end - shared:end])) if p]
            after = library.encode(text[end - shared:min(end + shared, len(text))], add_special_tokens=False) if places else None
            common = {end - shared + s for s, _ in after.offsets} if after else set()
            splice = max((p for p in places if p in starts and p in common), default=None)
            if splice is not None:
                counted, start = counted + starts[splice], splice
                break
            if shared == end - start - 1:
                break
            shared *= 2
        if splice is None:
            # no stable place in the whole chunk: take in more text at once
            size *= 2


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, huge: int = 65_536, size: int = 32_768, overlap: int = 256,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text: (id, n_bytes, n_tokens, over_limit).

    ``tokenizer``: a file of the tokenizers library (.json) or of sentencepiece (.model). Texts of more than ``huge``
    characters are counted by ``count_by_overlap`` when the tokenizer is byte-level BPE. A null text counts as empty:
    zero bytes and tokens. Repeated rows each get their row, a null id stays null, other columns are ignored.
    """
    def columns(batches):
        if tokenizer.endswith(".model"):
            import sentencepiece

            count = worker_value(sentencepiece.SentencePieceProcessor, tokenizer)
        else:
            encoder = worker_value(Encoder, tokenizer)
        for batch in batches:
            for ids, texts in (part.columns for part in slices(batch, 1)):
                if tokenizer.endswith(".model"):
                    n = np.array([len(count.encode(t)) for t in texts.to_pylist()], np.int64)
                else:
                    long = pc.greater(pc.utf8_length(texts), huge if encoder.cuts else 1 << 62)
                    n = np.diff(encoder.encode_all(pc.if_else(long, "", texts))[1], prepend=0)
                    for k in np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist():
                        n[k] = count_by_overlap(encoder.library, texts[k].as_py(), size, overlap)
                yield ids, pc.binary_length(texts), n, n > limit

    kind = dict(docs.dtypes)[id_col]
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_columns(chosen, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", columns)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))

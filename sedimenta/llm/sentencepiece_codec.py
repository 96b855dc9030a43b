"""SentencePiece encoding and decoding (operator 2): shared-prefix Viterbi.

A text is a sequence of marked words: a mark for each space before it, then its characters. No piece goes on behind a
word's end, so words are encoded singly and only once. The distinct words of a batch are sorted, which is a depth-first
walk of their trie: the forward table of a word keeps all entries of the prefix that it shares with the word before.

The entry of a prefix is its best last piece. For a unigram model that is the piece with the highest sum of scores. A
BPE model has no sums: its merges give every prefix one segmentation, and a sequence of pieces is that segmentation
exactly if merging any two neighbours' text gives back these two pieces. So the entry is the one piece that is
admissible behind the entry of the prefix before it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import Remembered, in_arrow, in_columns, slices, table, vocabulary, worker_value

MARK = "▁"
# Kinds of pieces in a model file, kinds of models, what an unknown piece costs and decodes to.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_COST = 10.0
UNKNOWN_TEXT = " ⁇ "
# bytes of text that are worked off at once; their words and ids take some thirty times as much for a moment
CHARS = 1_500_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Codec:
    """Encoder and decoder of one model file.

    About ``keep`` words and pairs of pieces are remembered, and of words no more than about ``64 * keep`` characters and
    bytes of ids, so that long words (hex, base64) take no more memory than usual ones.
    """

    def __init__(self, path: str, keep: int = 150_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self._plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self._scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self._ids):
            raise ValueError("pieces of several words are not supported")
        self._bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self._unknown_id = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        known = {c for p in self._ids for c in p}
        # a character that is no piece itself can stand in longer pieces only; such models would need lattice gaps
        if not all(c in self._ids for c in known):
            raise ValueError("every character of a piece must be a piece")
        self._stranger = re.compile("([^" + re.escape("".join(sorted(known))) + "])")
        # ends of pieces, with an id if they are pieces: behind what is no end of any piece no longer piece is found
        self._suffixes = {p[k:]: self._ids.get(p[k:]) for p in self._ids for k in range(len(p))}
        self._pieces = {i: p for p, i in self._ids.items()}
        self._texts = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type == NORMAL
            else UNKNOWN_TEXT.encode() if p.type == UNKNOWN else b"" for p in proto.pieces
        ]
        self._keep, self._words, self._pairs = keep, Remembered(keep // 2, 32 * keep), {}

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging neighbours, the best piece first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self._scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _admissible(self, before: int, piece: int) -> bool:
        """Whether a piece may stand behind another (-1: at the start)."""
        # one number: a pair of strings would take three times the memory
        key = before + 1 << 32 | piece
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= self._keep:
                self._pairs.clear()
            pair = [self._pieces[i] for i in (before, piece) if i >= 0]
            found = self._pairs[key] = self._merged("".join(pair)) == pair
        return found

    def _forward(self, run: str, end: int, last: list[int], sums: list[float]) -> None:
        """Append the entry for the first ``end`` characters of ``run``."""
        best, best_sum, suffix = None, -np.inf, self._suffixes.get
        for start in range(end - 1, -1, -1):
            piece = suffix(run[start:end], False)
            if piece is False:
                break
            if piece is None:
                continue
            if self.kind == BPE:
                if self._admissible(last[start], piece):
                    best, best_sum = piece, 0.0
                    break
            elif (total := sums[start] + self._scores[self._pieces[piece]]) > best_sum:
                best, best_sum = piece, total
        last.append(best)
        sums.append(best_sum)

    def _walk(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of sorted distinct runs, depth first through their trie."""
        found, before, last, sums = {}, "", [-1], [0.0]
        for run in runs:
            shared = 0
            for a, b in zip(before, run):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], sums[shared + 1:]
            for end in range(shared + 1, len(run) + 1):
                self._forward(run, end, last, sums)
            ids, end = [], len(run)
            while end:
                ids.append(last[end])
                end -= len(self._pieces[last[end]])
            found[run], before = np.array(ids[::-1], "<u4").tobytes(), run
        return found

    def _strange(self, char: str) -> bytes:
        return np.array([self._bytes[b] for b in char.encode()] if self._bytes else [self._unknown_id], "<u4").tobytes()

    def _learned(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of marked words; their first mark is left out in the names."""
        # odd places of a split hold the characters outside all pieces
        split = [self._stranger.split(MARK + w) for w in words]
        found = self._walk(sorted({run for parts in split for run in parts[::2] if run}))
        for w, parts in zip(words, split):
            yield w, found[parts[0]] if len(parts) == 1 else b"".join(
                self._strange(part) if k % 2 else found[part] for k, part in enumerate(parts) if part
            )

    def words(self, text: str) -> list[str]:
        """Marked words of a text, each without its first mark."""
        if not text:
            return []
        if not self._plain:
            text = self._library.normalize(text).removeprefix(MARK).replace(MARK, " ")
        elif MARK in text:
            text = text.replace(MARK, " ")
        if text[:1] != " " and text[-1:] != " " and "  " not in text:
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (non-null strings), one after another, and where each text's ids end."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = pc.split_pattern(texts, " ") if self._plain else None
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | \\z|{MARK}"), pc.equal(texts, ""))
        if lists is None or pc.all(odd).as_py():
            lists = pa.array([self.words(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        elif pc.any(odd).as_py():
            # only the odd texts become Python strings; the words of each text are taken from its own kind
            others = pa.array([self.words(t) for t in texts.filter(odd).to_pylist()], pa.list_(lists.type.value_type))
            at = np.where(odd_ := odd.to_numpy(zero_copy_only=False), len(lists) + np.cumsum(odd_) - 1, np.arange(len(lists)))
            lists = pa.concat_arrays([lists, others.cast(lists.type)]).take(pa.array(at))
        coded = lists.flatten().dictionary_encode()
        pool = self._words.all(coded.dictionary.to_pylist(), self._learned)
        sizes = np.array([len(p) // 4 for p in pool], np.int32)
        # Arrow lays the words' ids behind each other without an index per id
        known = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), np.frombuffer(b"".join(pool), np.int32))
        ends = np.r_[0, np.cumsum(sizes[coded.indices.to_numpy()], dtype=np.int64)]
        ids = pa.concat_arrays([known.take(coded.indices.slice(k, 1 << 16)).flatten() for k in range(0, len(coded), 1 << 16)] or [pa.array([], pa.int32())])
        return ids.to_numpy().view("<u4"), ends[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; without the space that encoding put before it."""
        text = b"".join(map(self._texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


def _coded(batches, model: str):
    """(other columns and texts of some rows, ids of each text, codec)."""
    codec = worker_value(Codec, model)
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1, CHARS):
            ids, ends = codec.encode_all(part.column(batch.num_columns - 1))
            yield part.columns, np.split(ids, ends[:-1]) if len(ends) else [], codec
            # else the allocator keeps what one part took, tens of MB a worker, beside what the next ones take
            pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every whole text. Null and empty texts have no ids. Repeated rows stay, other columns go."""
    def columns(batches):
        for (keys, _), each, _ in _coded(batches, model):
            yield keys, [len(ids) for ids in each], [ids.astype(np.int32) for ids in each]

    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_columns(chosen, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids array<int>", columns)


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of id lists; a null list gives the empty text."""
    def rows(batches):
        codec = worker_value(Codec, model)
        for keys, lists in batches:
            for key, ids in zip(keys, lists):
                yield key, codec.decode(np.array(ids or [], np.int64))

    return in_arrow(coded.select(id_col, ids_col), f"`{id_col}` {dict(coded.dtypes)[id_col]}, text string", rows, flush=500)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, restored): digests of ids and of the text decoded from them.

    ``restored`` is false only for texts that hold the mark itself, which decodes to a space, as in the library.
    """
    def columns(batches):
        for (keys, texts), each, codec in _coded(batches, model):
            back = [codec.decode(ids) for ids in each]
            yield (
                keys, [len(ids) for ids in each], [zlib.crc32(ids.tobytes()) for ids in each],
                [hashlib.sha256(t.encode()).hexdigest() for t in back], pc.equal(texts, pa.array(back, texts.type)),
            )

    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return in_columns(chosen, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, restored boolean", columns)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def tokenized(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: (doc_id, n_tokens, ids, decoded_sha256), the decoded text being that of the document.

    Unless the session bounds its Arrow batches already, they get a bound of two parts: Spark's own, of 10,000 rows, takes tens
    of MB more in each worker. The bound stays for the session. Results do not depend on it.
    """
    model = vocabulary("piece_bpe_32k.model")
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(2 * CHARS))

    def columns(batches):
        for (keys, _), each, codec in _coded(batches, model):
            digests = [hashlib.sha256(codec.decode(ids).encode()).hexdigest() for ids in each]
            yield keys, [len(ids) for ids in each], [ids.astype(np.int32) for ids in each], digests

    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return in_columns(chosen, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids array<int>, decoded_sha256 string", columns)

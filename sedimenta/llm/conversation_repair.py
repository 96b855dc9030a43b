"""Conversation structure repair (operator 13): cheapest edits by Four-Russians block tables.

Behind any row, what the rest of a conversation costs depends only on one of four states: at the start, behind a system
row, behind a user row, behind an assistant row. The four costs as a vector less their minimum take few values, so
all vectors and their transitions over one row are found once, and transitions over blocks of four rows are composed
from them. A conversation is then solved from its end by one lookup a block. To find the edits, blocks are expanded once
more from their end vectors, and of equally cheap edits the ASCII-least letter is taken, row by row from the front.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.llm.common import in_arrow, table
from sedimenta.session import written

DELETE, REROLE, INSERT, CUT_SHORT = 3, 2, 2, 1
BLOCK = 4
# rows and characters of a conversation that one task holds; longer ones are solved in pieces
HELD_ROWS, HELD_CHARS = 4096, 16_000_000
CHUNK_BITS = 12
START, SYSTEM, USER, ASSISTANT = range(4)
# the state behind an inserted or renamed row
_FOLLOWS = (USER, USER, ASSISTANT, USER)
_NO_STATE = None
# the state behind a kept row by its role's initial: s, u, a, other
_KEPT = (
    (SYSTEM, _NO_STATE, _NO_STATE, _NO_STATE), (USER, USER, _NO_STATE, USER),
    (_NO_STATE, _NO_STATE, ASSISTANT, _NO_STATE), (_NO_STATE,) * 4,
)
# symbols of rows: filler, one that must go, sound rows by initial, truncated rows by initial
FILLER, MUST_GO, SOUND, SHORT = 0, 1, 2, 6
SYMBOLS = 10
INITIALS = "sua"


def _with_inserts(costs: list[float]) -> tuple[float, ...]:
    for _ in range(2):
        costs = [min(c, INSERT + costs[_FOLLOWS[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


END = _with_inserts([0, np.inf, np.inf, 0])


def _before(after: tuple, symbol: int) -> tuple:
    """Costs in front of a row from those behind it."""
    if symbol == FILLER:
        return after
    out = []
    for state in range(4):
        costs = [DELETE + after[state]]
        if symbol != MUST_GO:
            short = CUT_SHORT if symbol >= SHORT else 0
            costs.append(short + REROLE + after[_FOLLOWS[state]])
            if (kept := _KEPT[(symbol - SOUND) % 4][state]) is not None:
                costs.append(short + after[kept])
        out.append(min(costs))
    return _with_inserts(out)


class Blocks:
    """Vectors without their minimum, transitions over rows and over blocks, and edits by vector, symbol and state."""

    def __init__(self):
        number, self.vectors, steps = {END: 0}, [END], []
        for vector in self.vectors:
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(vector, symbol)
                least = min(costs)
                normal = tuple(c - least for c in costs)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append((number[normal], least))
            steps.append(row)
        found = np.array(steps, np.int32)
        self.next, self.more = found[:, :, 0], found[:, :, 1]
        # a row in front of a stretch: the stretch is met first, then the row
        ahead, more = self.next, self.more
        for _ in range(BLOCK - 1):
            more = (more[:, None, :] + np.swapaxes(self.more[ahead], 1, 2)).reshape(len(found), -1)
            ahead = np.swapaxes(self.next[ahead], 1, 2).reshape(len(found), -1)
        self.block_next, self.block_more = ahead, more
        self._edits: dict[tuple[int, int, int], tuple[str, int]] = {}

    def ends(self, symbols: bytes, end: int) -> tuple[list[int], bytes, int, int]:
        """(vector behind each block, symbols filled up in front, vector in front of all, cost added) for a stretch that ends before vector ``end``."""
        filled = bytes(-len(symbols) % BLOCK) + symbols
        digits = np.frombuffer(filled, np.uint8).reshape(-1, BLOCK).astype(np.int64)
        codes = (digits * SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).sum(axis=1)
        out, cost = [], 0
        for code in codes[::-1].tolist():
            out.append(end)
            cost += int(self.block_more[end, code])
            end = int(self.block_next[end, code])
        return out[::-1], filled, end, cost

    def _edit(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """Letters for one row (inserts before it, then its own) and the state behind it."""
        key = (after, symbol, state)
        if key in self._edits:
            return self._edits[key]
        behind, letters = self.vectors[after], ""
        front = _before(behind, symbol)
        short = CUT_SHORT if symbol >= SHORT else 0
        while True:
            kept = _KEPT[(symbol - SOUND) % 4][state] if symbol != MUST_GO else None
            # in the order of the letters
            if DELETE + behind[state] == front[state]:
                letters += "D"
            elif INSERT + front[_FOLLOWS[state]] == front[state]:
                letters, state = letters + "I", _FOLLOWS[state]
                continue
            elif kept is not None and short + behind[kept] == front[state]:
                letters, state = letters + "K", kept
            else:
                letters, state = letters + "R", _FOLLOWS[state]
            self._edits[key] = letters, state
            return letters, state

    def trace(self, symbols: bytes, end: int, state: int) -> tuple[list[str], list[int], int]:
        """Letters of every row of a stretch and the states the rows are met in, for one entered in ``state`` that ends before vector ``end``."""
        behind, filled, _, _ = self.ends(symbols, end)
        out, states = [], []
        for k, vector in enumerate(behind):
            block = filled[k * BLOCK:(k + 1) * BLOCK]
            vectors = [vector]
            for symbol in block[:0:-1]:
                vectors.append(int(self.next[vectors[-1], symbol]))
            for symbol, after in zip(block, reversed(vectors)):
                if symbol != FILLER:
                    states.append(state)
                    letters, state = self._edit(after, symbol, state)
                    out.append(letters)
        return out, states, state

    @staticmethod
    def tail(state: int) -> str:
        """Inserts behind the last row."""
        out = ""
        while END[state]:
            out, state = out + "I", _FOLLOWS[state]
        return out


@lru_cache(maxsize=1)
def blocks() -> Blocks:
    return Blocks()


def symbol_of(role: str, fault: str | None) -> int:
    if fault in ("blank", "duplicate"):
        return MUST_GO
    initial = INITIALS.find(role[0]) if role and role[0] in INITIALS else len(INITIALS)
    return (SHORT if fault == "truncated" else SOUND) + initial


def _is_legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def rows_of(letters: Iterable[tuple[str, str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) rows from (letters, role, text) of damaged rows."""
    for edits, role, text in letters:
        for edit in edits:
            if edit == "D":
                continue
            if edit == "K":
                state = _KEPT[INITIALS.index(role[0])][state]
                yield role, text
                continue
            state = _FOLLOWS[state]
            yield ("user", "assistant")[state == ASSISTANT], text if edit == "R" else ""


def _cost(letters: str, short: bool) -> int:
    return sum({"D": DELETE, "R": REROLE, "I": INSERT}.get(e, 0) for e in letters) + (CUT_SHORT if short and "D" not in letters else 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, there, role, text, fault): the rows of a table after seeded damage; dropped rows are not ``there``.

    Nulls of conv_id and turn count as one space where the damage is chosen, those of role and text become one space.
    ``fault`` is blank, truncated or null; duplicates are found in the order of a conversation.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("damage"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", (F.col("damage") != 0).alias("there"), role.alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("copies"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    short = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, F.lit("blank")).when(short, F.lit("truncated")).alias("fault")
    return rows.select("conv_id", "turn", "there", "role", "text", fault, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")


_PART = "part bigint, whole boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, rows array<struct<role:string,text:string>>"


def _solved(rows: list[tuple]) -> tuple:
    """Everything about one conversation held in memory: (turn, there, role, text, fault) rows in order."""
    tables, seen, symbols, faults = blocks(), set(), bytearray(), []
    real = [r for r in rows if r[1]]
    for _, _, role, text, fault in real:
        if fault != "blank":
            fault = "duplicate" if (role, text) in seen else fault
            seen.add((role, text))
        faults.append(fault)
        symbols.append(symbol_of(role, fault))
    turns = {r[0] for r in real if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(not _is_legal(a[2][:1], b[2][:1]) for a, b in zip(real, real[1:]))
    letters, _, state = tables.trace(bytes(symbols), 0, START)
    _, _, front, cost = tables.ends(bytes(symbols), 0)
    tail = tables.tail(state)
    repaired = [*rows_of([(e, r[2], r[3]) for e, r in zip([*letters, tail], [*real, (None, True, "", "", None)])])]
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return 0, True, gaps, *count, illegal, cost + int(tables.vectors[front][START]), "".join(letters) + tail, repaired


def _first_pass(batches, held_rows: int):
    """Whole conversations solved; rows of those that a task may not see whole, or that are too long, as they are."""
    from pyspark import TaskContext

    base, at, run, held, chars, whole = TaskContext.get().partitionId() << 40, 0, None, [], 0, False
    nothing = (None,) * 10
    first = True
    for columns in batches:
        for conv, turn, there, role, text, fault in zip(*columns):
            if first or conv != run:
                # a partition's first conversation may have begun in the one before
                if whole and held:
                    yield run, *_solved(held), *(None,) * 6
                elif held:
                    for k, row in enumerate(held):
                        yield run, *nothing, at - len(held) + k + base, *row
                whole = not first
                run, held, chars, first = conv, [], 0, False
            held.append((turn, there, role, text, fault))
            at += 1
            chars += len(text or "")
            if len(held) > held_rows or chars > HELD_CHARS or not whole:
                for k, row in enumerate(held):
                    yield run, *nothing, at - len(held) + k + base, *row
                held, chars, whole = [], 0, False
    # the last one may go on in the next partition
    for k, row in enumerate(held):
        yield run, *nothing, at - len(held) + k + base, *row


def _ends_of_chunks(batches):
    """From the last chunk of a conversation to the first: (name, chunk, vector behind it)."""
    tables, run, vector = blocks(), None, 0
    for columns in batches:
        for name, chunk, symbols in zip(*columns):
            if name != run:
                run, vector = name, 0
            yield name, chunk, vector
            vector = tables.ends(bytes(symbols), vector)[2]


def _letters_of_chunks(batches):
    """From the first chunk to the last: (name, chunk, letters and state of each row, letters behind the chunk)."""
    tables, held, run, state = blocks(), None, None, START
    for columns in batches:
        for name, chunk, symbols, end in zip(*columns):
            if held:
                yield *held, "" if name == run else tables.tail(state)
            state = state if name == run else START
            run = name
            letters, states, state = tables.trace(bytes(symbols), end, state)
            held = name, chunk, letters, states
    if held:
        yield *held, tables.tail(state)


def _in_pieces(rows: DataFrame, kind: str) -> DataFrame:
    """Parts of conversations that no task holds whole; ``rows``: written (conv_id, seq, turn, there, role, text, fault).

    Rows meet in their conversation's task as one symbol each, 4,096 in a chunk. Texts are joined to their edits by row.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("name")
    rows = rows.withColumn("name", name)
    real = rows.filter("there").withColumn("digest", F.sha2("text", 256))
    firsts = real.groupBy("name", "role", "digest").agg(F.min("seq").alias("first"))
    same = F.when(F.col("fault").eqNullSafe("blank"), F.col("fault")).when(F.col("seq") > F.col("first"), F.lit("duplicate")).otherwise(F.col("fault"))
    initial = F.substring("role", 1, 1)
    place = F.instr(F.lit(INITIALS), initial)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(MUST_GO)).otherwise(
        F.when(F.col("fault").eqNullSafe("truncated"), F.lit(SHORT)).otherwise(F.lit(SOUND)) + F.when((initial == "") | (place == 0), F.lit(len(INITIALS))).otherwise(place - 1)
    )
    marked = real.join(firsts, ["name", "role", "digest"]).withColumn("fault", same)
    marked = written(marked.select("name", "conv_id", "seq", F.shiftright("seq", CHUNK_BITS).alias("chunk"), "role", "text", "fault", symbol.alias("symbol"), initial.alias("initial")), "repair-rows")
    # chunks are bounded by the numbering; one row of each chunk sees the initial before it
    items = F.array_sort(F.collect_list(F.struct("seq", "symbol", "initial"))).alias("items")
    chunks = marked.groupBy("name", "chunk").agg(items)
    chunks = written(chunks.select(
        "name", "chunk", F.col("items.seq").alias("seqs"), F.col("items.symbol").alias("symbols"), F.col("items.initial").alias("initials")
    ), "repair-chunks")
    symbols = chunks.select("name", "chunk", "symbols")
    down = symbols.repartition("name").sortWithinPartitions("name", F.desc("chunk"))
    ends = written(in_arrow(down, "name string, chunk bigint, vector int", _ends_of_chunks), "repair-ends")
    up = symbols.join(ends, ["name", "chunk"]).select("name", "chunk", "symbols", "vector").repartition("name").sortWithinPartitions("name", "chunk")
    edits = written(in_arrow(up, "name string, chunk bigint, letters array<string>, states array<int>, tail string", _letters_of_chunks, flush=100), "repair-edits")
    # per chunk: initials that may not follow each other, also over the border
    order = Window.partitionBy("name").orderBy("chunk")
    pairs = F.concat(F.array(F.col("before")), "initials")
    lines = chunks.select("name", "chunk", "initials", F.lag(F.element_at("initials", -1)).over(order).alias("before"))
    wrong = F.size(F.filter(F.sequence(F.lit(2), F.size(pairs)), lambda k: F.element_at(pairs, k - 1).isNotNull() & ~F.concat(F.element_at(pairs, k - 1), F.element_at(pairs, k)).isin("su", "ua", "au")))
    illegal = lines.groupBy("name").agg(F.sum(wrong).alias("illegal"))
    turns = rows.groupBy("name").agg(
        F.first("conv_id").alias("conv_id"), F.max(F.when(F.col("there"), F.col("turn"))).alias("high"), F.min(F.when(F.col("there"), F.col("turn"))).alias("low"),
        F.countDistinct(F.when(F.col("there"), F.col("turn"))).alias("different"),
    )
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<role:string,text:string>>")
    heads = turns.join(illegal, "name", "left").select(
        "conv_id", F.lit(-1).cast("bigint").alias("part"), F.lit(False).alias("whole"),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("different"), zero).cast("bigint").alias("gaps"),
        zero.alias("blank"), zero.alias("duplicate"), zero.alias("truncated"), F.coalesce("illegal", zero).alias("illegal"), zero.alias("cost"), F.lit("").alias("audit"), none.alias("rows"),
    )
    zipped = edits.join(chunks.select("name", "chunk", "seqs"), ["name", "chunk"])
    each = zipped.select("letters", "states", "tail", "seqs", F.posexplode("seqs").alias("k", "seq")).select(
        "seq", F.element_at("letters", F.col("k") + 1).alias("edits"), F.element_at("states", F.col("k") + 1).alias("state"),
        F.when(F.col("k") == F.size("seqs") - 1, F.col("tail")).otherwise(F.lit("")).alias("tail"),
    )

    def parts(batches):
        for columns in batches:
            for conv, seq, role, text, fault, edits, state, tail in zip(*columns):
                faults = [int(fault == f) for f in ("blank", "duplicate", "truncated")]
                repaired = [*rows_of([(edits, role, text), (tail, "", "")], state)]
                yield conv, seq, False, 0, *faults, 0, _cost(edits + tail, fault == "truncated"), edits + tail, repaired

    chosen = marked.join(each, "seq").select("conv_id", "seq", "role", "text", "fault", "edits", "state", "tail")
    return heads.unionByName(in_arrow(chosen, f"conv_id {kind}, {_PART}", parts, flush=500))


def repaired(rows: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """Cheapest repair of conversations: (conv_id, part, whole, counts..., cost, audit, rows) in one or more parts each.

    ``rows``: (conv_id, turn, there, role, text, fault) as ``damaged`` gives them; rows that are not ``there`` only name
    their conversation. Rows are taken by turn, nulls first, and within a turn by a hash of role and text; a row equal to
    an earlier one of its conversation is a duplicate. Edits: keep 0, rename to user or assistant 2, delete 3, insert an
    empty user or assistant row 2; a truncated row that stays costs 1 more. Of equally cheap edits the ASCII-least letters
    are taken. ``audit`` and ``rows`` (role, text) of the parts in order make the conversation; counts and costs add up.

    A conversation that a task sees whole and that has at most ``held_rows`` rows is one part (``whole``). Tasks
    get ranges of (conversation, turn), so a conversation of very many rows is spread; such ones, and those at the borders of ranges,
    have one part a row and one for what is counted once. Null ids are one conversation; empty tables give no rows.
    """
    kind = dict(rows.dtypes)["conv_id"]
    spark = rows.sparkSession
    rows = rows.select("conv_id", "turn", "there", F.when(F.col("there"), F.col("role")).alias("role"), F.when(F.col("there"), F.col("text")).alias("text"), "fault")
    keys = ["conv_id", "turn", "_tie", "_row"]
    keyed = rows.withColumn("_tie", F.xxhash64("role", "text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    turn = dict(rows.dtypes)["turn"]
    raw = f"seq bigint, raw_turn {turn}, raw_there boolean, raw_role string, raw_text string, raw_fault string"
    once = written(in_arrow(ordered.select("conv_id", "turn", "there", "role", "text", "fault"), f"conv_id {kind}, {_PART}, {raw}", lambda b: _first_pass(b, held_rows), flush=500), "repair")
    done = once.filter("whole").select("conv_id", *[c.split()[0] for c in _PART.split(", ")[:-1]], "rows")
    left = once.filter("whole is null").select("conv_id", "seq", *[F.col(f"raw_{c}").alias(c) for c in ("turn", "there", "role", "text", "fault")])
    return done.unionByName(_in_pieces(left, kind))


def _digests(batches):
    """Sums, letters and hash of the conversations that came in parts, part after part."""
    run, sums, letters, digest, empty = None, None, None, None, True
    for columns in batches:
        for name, conv, part, *counts, audit, rows in zip(*columns):
            if name != run:
                if run is not None:
                    yield sums[0], *sums[1], "".join(letters), digest.hexdigest()
                run, sums, letters, digest, empty = name, (conv, [0] * len(counts)), [], hashlib.sha256(), True
            sums = conv, [a + b for a, b in zip(sums[1], counts)]
            letters.append(audit)
            for row in rows:
                digest.update(f"{'' if empty else chr(10)}{row['role']}:{row['text']}".encode())
                empty = False
    if run is not None:
        yield sums[0], *sums[1], "".join(letters), digest.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, counts..., audit, repaired_sha256) of every conversation; the hash is of ``role:text`` lines.

    Hashing a text is sequential, so the parts of one conversation are streamed through one task; nothing of it is held
    but its letters.
    """
    kind = dict(parts.dtypes)["conv_id"]
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = parts.filter("whole").select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("name")
    rest = parts.filter("not whole").select(name, "conv_id", "part", *COUNTS, "audit", "rows").repartition("name").sortWithinPartitions("name", "part")
    schema = f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    return whole.unionByName(in_arrow(rest, schema, _digests, flush=500))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return digests(repaired(damaged(table(spark, sf_dir, "conversations"))))

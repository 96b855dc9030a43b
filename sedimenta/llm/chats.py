"""Chat formatting (operator 4): cumulative-snapshot collapse, on DataFrame functions only.

Logs hold a conversation again after every turn. A prefix of a conversation is all its rows up to some turn; its hash
is a sum of row hashes that rolls from turn to turn. A conversation whose whole hash is a prefix hash of a longer one is
a snapshot and goes; of conversations with the same rows the one with the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import table

BLOCK = 4096
# Marks of the public chat template.
START, END = "<|im_start|>", "<|im_end|>\n"
LANES = ["n", "h1", "h2", "h3", "h4"]


def _running(rows: DataFrame, group: str, place: str, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add running sums (name -> summed column) of a group up to and including a row, in two levels.

    Rows are summed inside blocks of ``BLOCK`` places, and the totals of the blocks among themselves, so a group with
    very many rows is spread over its blocks. Both windows run through without holding their rows.
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / BLOCK))
    totals = rows.groupBy(group, "_block").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col(group).alias("_group"), F.col("_block").alias("_at"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    inside = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    joined = summed.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_at")))
    kept = [c for c in rows.columns if c != "_block"]
    return joined.select(*kept, *[(F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in sums])


def _row_hashes(turn: Column, role: Column, text: Column) -> dict[str, Column]:
    """Two 64-bit hashes of a row as four 31-bit numbers, whose sums cannot overflow."""
    parts = [turn, role.isNull(), role, text.isNull(), text]
    one, two, low = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts), F.lit((1 << 31) - 1)
    return {
        "h1": one.bitwiseAND(low), "h2": F.shiftrightunsigned(one, 33), "h3": two.bitwiseAND(low), "h4": F.shiftrightunsigned(two, 33),
    }


def maximal(chats: DataFrame) -> DataFrame:
    """(conv_id) of conversations that are no snapshot of another one, from (conv_id, turn, role, text)."""
    place = F.coalesce(F.col("turn").cast("bigint"), F.lit(-1))
    hashed = chats.select("conv_id", place.alias("place"), F.lit(1).alias("n"), *[c.alias(n) for n, c in _row_hashes(F.col("turn"), F.col("role"), F.col("text")).items()])
    turns = hashed.groupBy("conv_id", "place").agg(*[F.sum(c).alias(c) for c in LANES])
    prefixes = _running(turns.select("conv_id", "place", *[F.col(c).alias(f"of_{c}") for c in LANES]), "conv_id", "place", ["place"], {c: f"of_{c}" for c in LANES})
    # every conversation is a prefix of itself; one more makes it a snapshot
    holders = prefixes.groupBy(*LANES).agg(F.count("*").alias("holders"))
    whole = turns.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in LANES])
    same = whole.groupBy(*LANES).agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    snapshots = holders.join(same.select(*LANES, "copies"), LANES).filter("holders > copies").select(*LANES)
    return same.join(snapshots, LANES, "left_anti").select("conv_id")


def rendered(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of the maximal conversations in the chat template: (conv_id, turn, start, rendered).

    ``start`` is the number of characters of the conversation before the row, so the rows in order of ``start`` make up
    its text; a conversation of any length is never gathered into one value. Rows of one turn are ordered by role and
    text; null turns come first and are one turn; null roles are rendered as ``unknown``, null texts as empty; rows
    without a conversation id are one conversation. Repeated rows stay and count. Other columns are ignored.
    """
    rows = chats.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    keep = maximal(rows).select(F.col("conv_id").alias("_keep"))
    kept = rows.join(keep, F.col("conv_id").eqNullSafe(F.col("_keep")), "left_semi")
    shown = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END))
    kept = kept.withColumn("rendered", shown).withColumn("place", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)))
    kept = kept.withColumn("length", F.length("rendered").cast("bigint"))
    ended = _running(kept, "conv_id", "place", ["place", "role", "text"], {"ended": "length"})
    return ended.select("conv_id", "turn", (F.col("ended") - F.col("length")).alias("start"), "rendered")


def op4_chats(spark, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


SQL = f"""WITH rows_ AS (SELECT conv_id, turn, coalesce(turn, -1) AS place, role, text FROM conversations),
logs AS (SELECT conv_id, list({{'p': place, 'r': role, 't': text}} ORDER BY place, role NULLS FIRST, text NULLS FIRST) AS l, max(place) AS last_place FROM rows_ GROUP BY conv_id),
kept AS (SELECT a.conv_id FROM logs a WHERE NOT EXISTS (SELECT 1 FROM logs b WHERE b.conv_id <> a.conv_id AND b.l[1:len(a.l)] = a.l
  AND ((len(b.l) > len(a.l) AND b.l[len(a.l) + 1].p > a.last_place) OR (len(b.l) = len(a.l) AND b.conv_id < a.conv_id)))),
shown AS (SELECT r.*, '{START}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{END.rstrip()}' || chr(10) AS rendered FROM rows_ r JOIN kept USING (conv_id))
SELECT conv_id, turn, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place, role NULLS FIRST, text NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, rendered FROM shown"""

"""Near-duplicates by similarity (stage simhash_near_dedup): SimHash and MinHash bands find pairs, their shingles decide.

Two documents are near-duplicates if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Their
64-bit fingerprints then differ in about ten bits, which may lie in all eight bytes, so the index of shared bytes of
operator 1 cannot find all of them. The stage's pairs come from that index first, and from the signatures of operator 12 over
five words besides: a pair at 0.8 shares none of 32 bands with a chance of 3.1e-6. Every pair is decided by its shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.linked_sets import linked
from sedimenta.llm.super_minhash import PERCENT, described_sets, distinct_sets, sets_of
from sedimenta.session import removed, scratch_path, written

WORDS = 5


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs_of=None) -> DataFrame:
    """One row per document: (id, component_id), the smallest id that can be reached over near-duplicates.

    ``pairs_of(docs, nodes, text_col)`` gives pairs (a, b) of sets' keys that are looked at besides those of the bands.

    Texts with equal sets are one node however many documents have them; texts without words (null and empty ones too)
    are one node. Repeated rows stay; a null id keeps its row and counts only if a component has no other id.
    """
    each = written(described_sets(docs, id_col, text_col, WORDS), "similar")
    path = scratch_path(docs.sparkSession, "similar-nodes")
    nodes = written(distinct_sets(each, id_col), "similar-nodes", path)
    roots = linked(nodes, sets_of(docs, nodes, text_col, words=WORDS), PERCENT, "similar", pairs_of and pairs_of(docs, nodes, text_col))
    removed(docs.sparkSession, path)
    each = each.select(id_col, F.coalesce("key", F.lit(0)).alias("key"))
    placed = each.groupBy("key").agg(F.min(id_col).alias("least")).join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(placed.join(least, "root").select("key", "component_id"), "key").select(id_col, "component_id")

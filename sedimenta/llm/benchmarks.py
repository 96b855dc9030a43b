"""Benchmark decontamination (operator 8): template canonicalisation, on DataFrame functions only.

Texts become templates: words lose outer punctuation, numbers, units and names become typed placeholders, the rest is
in lower case. Windows of a template that a document shares with a benchmark item are found by a join on their hashes.
The values behind the placeholders may differ, as in a question asked again with other numbers and names, but only
consistently: equal values of the item are equal in the document too, and different ones different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import table
from sedimenta.session import written

WINDOW = 8
# words of a window that must not be placeholders
LITERALS = 4
# windows of an item that a document must share, anywhere and in any order, or all if the item has fewer
SHARED = 6
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
# Units of measure and money that are no common words.
UNITS = (
    "mm cm km ft yd mg kg oz lb lbs ml cl dl hz khz mhz ghz kwh kcal bar mol eur usd gbp euro euros dollar dollars cent cents "
    "percent meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches gram grams "
    "kilogram kilograms liter liters litre litres hour hours minute minutes seconds days weeks months years"
).split()
# Signs that may stand around a word.
SIGNS = ".,;:!?\"'()[]{}<>*&%$#@|~^_=+/\\-`…«»“”‘’„–—¿¡"


def bare_words(text: Column) -> Column:
    """Words between ASCII white space without the signs around them; what has only signs is no word."""
    split = F.split(F.coalesce(text, F.lit("")), "[\\x09-\\x0D\\x20]+")
    return F.array_remove(F.transform(split, lambda w: F.btrim(w, F.lit(SIGNS))), "")


def placeholder(word: Column) -> Column:
    """A word as it stands in a template: <number> if it starts with a digit, <unit>, <name> if only its first letter
    is a capital, else its lower case."""
    first = F.substring(word, 1, 1)
    lower = F.lower(word)
    digit = F.ascii(word).between(48, 57)
    name = (F.lower(first) != first) & (F.concat(F.lower(first), F.substring(word, 2, 1 << 30)) == lower) & (F.length(word) > 1)
    return (
        F.when(digit, F.lit(NUMBER))
        .when(word == lower, F.when(word.isin(UNITS), F.lit(UNIT)).otherwise(word))
        .when(name, F.lit(NAME))
        .otherwise(F.when(lower.isin(UNITS), F.lit(UNIT)).otherwise(lower))
    )


def _template(words: Column) -> Column:
    return F.transform(words, placeholder)


def _lower(words: Column) -> Column:
    return F.transform(words, F.lower)


def _starts(template: Column) -> Column:
    return F.when(F.size(template) >= WINDOW, F.sequence(F.lit(1), F.size(template) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))


def _slots(words: Column, template: Column, at: Column) -> Column:
    """Values behind the placeholders of a window, in order."""
    pairs = F.arrays_zip(F.slice(template, at, WINDOW).alias("t"), F.slice(words, at, WINDOW).alias("w"))
    return F.transform(F.filter(pairs, lambda p: p["t"].isin(NUMBER, UNIT, NAME)), lambda p: p["w"])


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, item_id, n_windows, place, slots) of every window of an item with enough words that are no placeholders.

    Items of fewer than ``WINDOW`` words have none, so they cannot be found.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), bare_words(F.col(text_col)).alias("words"))
    items = items.withColumn("template", _template(F.col("words"))).withColumn("place", F.explode(_starts(F.col("template"))))
    window = F.slice("template", F.col("place"), WINDOW)
    literal = F.size(F.filter(window, lambda w: ~w.isin(NUMBER, UNIT, NAME)))
    found = items.filter(literal >= LITERALS).select(
        F.xxhash64(window).alias("hash"), "item_id", "place", _slots(F.col("words"), F.col("template"), F.col("place")).alias("slots")
    ).distinct()
    sizes = found.groupBy(F.col("item_id").alias("_item")).agg(F.countDistinct("place").alias("n_windows"))
    return found.join(sizes, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")


def plain_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, item_id, n_places, place) of every window of an item as it is written, in lower case."""
    items = benchmark.select(F.col(item_col).alias("item_id"), _lower(bare_words(F.col(text_col))).alias("words"))
    places = items.withColumn("place", F.explode(_starts(F.col("words"))))
    found = places.select(F.xxhash64(F.slice("words", F.col("place"), WINDOW)).alias("hash"), "item_id", "place").distinct()
    sizes = found.groupBy(F.col("item_id").alias("_item")).agg(F.countDistinct("place").alias("n_places"))
    return found.join(sizes, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", plain: bool = False,
) -> DataFrame:
    """(id, item_id, shared_windows, n_windows, reworded): documents that hold a benchmark item, one row per pair.

    A pair is reported if the document shares at least ``SHARED`` windows of the item's template, or all of them, each
    with consistent placeholders. ``reworded``: some value behind a placeholder differs. With ``plain`` a pair is also
    reported if it shares as many of all windows of the item, each in its template or word by word whatever the case
    (so copies in other case, and items of names and numbers only, are found); its counts are then of all windows.
    Null texts hold nothing; rows of one id count as one document, a null id too; repeated rows change nothing; empty
    tables give no rows; other columns are ignored.

    Only hashes go through the first join, whose small side is the distinct hashes of the items. Words are looked at
    again only in documents with a hit. The small sides of both joins are written first, so the planner knows their size.
    """
    items = written(item_windows(benchmark, item_col, item_text_col), "benchmark-windows")
    wanted = items.select(F.lit(False).alias("plain"), "hash")
    if plain:
        whole = written(plain_windows(benchmark, item_col, item_text_col), "benchmark-plain")
        wanted = wanted.unionByName(whole.select(F.lit(True).alias("plain"), "hash"))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    text_hash = F.xxhash64("text").alias("version")
    texts = chosen.select("id", text_hash, bare_words(F.col("text")).alias("words"))
    forms = [(False, _template(F.col("words"))), *([(True, _lower(F.col("words")))] if plain else [])]
    texts = texts.select("id", "version", F.explode(F.array(*[F.struct(F.lit(p).alias("plain"), w.alias("words")) for p, w in forms])).alias("f"))
    texts = texts.select("id", "version", "f.plain", "f.words")
    hashes = F.transform(_starts(F.col("words")), lambda at: F.xxhash64(F.slice("words", at, WINDOW)))
    windows = texts.select("id", "version", "plain", F.posexplode(hashes).alias("at", "hash"))
    hits = windows.join(written(wanted.distinct(), "benchmark-hashes"), ["plain", "hash"], "left_semi")
    hits = written(hits.distinct(), "benchmark-hits")

    lists = hits.filter("not plain").groupBy("id", "version").agg(F.collect_list(F.struct("hash", "at")).alias("hits"))
    versions = chosen.withColumn("version", F.xxhash64("text")).alias("d")
    with_hits = versions.join(lists.alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.version") == F.col("h.version")))
    words = with_hits.select("d.id", "h.hits", bare_words(F.col("text")).alias("words"))
    words = words.withColumn("template", _template(F.col("words")))
    slots = F.transform("hits", lambda h: F.struct(h["hash"].alias("hash"), _slots(F.col("words"), F.col("template"), h["at"] + 1).alias("values")))
    each = words.select("id", F.explode(slots).alias("s")).select("id", "s.hash", "s.values").distinct()
    count = lambda c: F.size(F.array_distinct(c))
    pairs = F.arrays_zip(F.col("values").alias("d"), F.col("slots").alias("i"))
    same = (count(pairs) == count(F.col("values"))) & (count(pairs) == count(F.col("slots")))
    matched = each.join(items, "hash").filter(same)
    per_place = matched.groupBy("id", "item_id", "n_windows", "place").agg(F.min(F.col("values") != F.col("slots")).alias("other"))
    if plain:
        exact = hits.filter("plain").select("id", "hash").distinct().join(whole, "hash").select("id", "item_id", "place", F.lit(True).alias("exact"))
        sizes = whole.select(F.col("item_id").alias("_item"), "n_places").distinct()
        per_place = per_place.withColumn("exact", F.lit(False)).unionByName(exact.distinct(), allowMissingColumns=True)
        per_place = per_place.groupBy("id", "item_id", "place").agg(F.max("n_windows").alias("n_windows"), F.max("other").alias("other"), F.max("exact").alias("exact"))
        per_pair = per_place.groupBy("id", "item_id").agg(
            F.max("n_windows").alias("n_windows"), F.count("n_windows").alias("in_template"), F.count("*").alias("in_all"), F.max("other").alias("other"),
            F.max(F.col("other") & ~F.col("exact")).alias("other_in_all"),
        ).join(sizes, F.col("item_id").eqNullSafe(F.col("_item")))
        template = F.coalesce(F.col("in_template") >= F.least(F.lit(SHARED), F.col("n_windows")), F.lit(False))
        return per_pair.filter(template | (F.col("in_all") >= F.least(F.lit(SHARED), F.col("n_places")))).select(
            F.col("id").alias(id_col), "item_id", F.when(template, F.col("in_template")).otherwise(F.col("in_all")).alias("shared_windows"),
            F.when(template, F.col("n_windows")).otherwise(F.col("n_places")).alias("n_windows"),
            F.when(template, F.col("other")).otherwise(F.coalesce("other_in_all", F.lit(False))).alias("reworded"),
        )
    return (
        per_place.groupBy("id", "item_id", "n_windows")
        .agg(F.count("*").alias("shared_windows"), F.max("other").alias("reworded"))
        .filter(F.col("shared_windows") >= F.least(F.lit(SHARED), F.col("n_windows")))
        .select(F.col("id").alias(id_col), F.col("item_id"), "shared_windows", "n_windows", "reworded")
    )


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """By templates only, as ``SQL`` states it."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_benchmarks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item, by template or word by word, go; the others stay with all columns."""
    found = written(contaminated(docs, table(spark, sf_dir, "benchmark"), plain=True).select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found"]), "left_anti")


_BARE = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda w: trim(w, '{SIGNS.replace(chr(39), chr(39) * 2)}')), lambda w: w <> '')"
_UNITS = "(" + ", ".join(f"'{u}'" for u in UNITS) + ")"
_PLACEHOLDER = f"""CASE WHEN w[1] BETWEEN '0' AND '9' THEN '{NUMBER}'
 WHEN w = lower(w) THEN CASE WHEN w IN {_UNITS} THEN '{UNIT}' ELSE w END
 WHEN lower(w[1]) <> w[1] AND lower(w[1]) || w[2:] = lower(w) AND length(w) > 1 THEN '{NAME}'
 ELSE CASE WHEN lower(w) IN {_UNITS} THEN '{UNIT}' ELSE lower(w) END END"""


def _sql_windows(name: str, id_col: str) -> str:
    return f"""{name}_words AS (SELECT {id_col} AS id, {_BARE} AS words FROM {name}),
{name}_templates AS (SELECT id, words, list_transform(words, lambda w: {_PLACEHOLDER}) AS template FROM {name}_words),
{name}_places AS (SELECT *, unnest(range(1, len(template) - {WINDOW - 2})) AS place FROM {name}_templates),
{name}_windows AS (SELECT id, place, template[place:place + {WINDOW - 1}] AS win,
  list_filter(list_zip(template[place:place + {WINDOW - 1}], words[place:place + {WINDOW - 1}]), lambda p: p[1] IN ('{NUMBER}', '{UNIT}', '{NAME}')) AS slots
  FROM {name}_places)"""


SQL = f"""WITH {_sql_windows('documents', 'doc_id')}, {_sql_windows('benchmark', 'item_id')},
items AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_windows FROM benchmark_windows
  WHERE len(list_filter(win, lambda w: w NOT IN ('{NUMBER}', '{UNIT}', '{NAME}'))) >= {LITERALS}),
matched AS (SELECT d.id AS doc_id, i.id AS item_id, i.n_windows, i.place, min((d.slots <> i.slots)::INT) AS other
  FROM documents_windows d JOIN items i ON d.win = i.win
  WHERE len(list_distinct(list_zip(d.slots, i.slots))) = len(list_distinct(d.slots)) AND len(list_distinct(d.slots)) = len(list_distinct(i.slots))
  GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS shared_windows, n_windows, max(other) = 1 AS reworded FROM matched
GROUP BY doc_id, item_id, n_windows HAVING count(*) >= least({SHARED}, n_windows)"""

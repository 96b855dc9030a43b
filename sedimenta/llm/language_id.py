"""Language ID (operator 6): sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed letter n-grams (1 to 3 characters, words marked by spaces) with logarithmic term frequency and
inverse document frequency over all labelled documents. The weights are learned with follow-the-regularised-leader and
elastic-net penalties on a bounded sample of labelled documents, the temperature of the softmax on a part kept out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import in_arrow, table, worker_value

DIMS = 1 << 15
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def gram_counts(text: str, letters: np.ndarray, part: int = 1 << 20) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text, worked off in parts; none if it has no letter."""
    counts, any_letter = np.zeros(DIMS, np.int64), False
    lowered = text.lower()
    for k in range(0, len(lowered), part):
        # two characters of overlap and one space at either end of the text
        piece = lowered[max(0, k - 2):k + part]
        codes = letters[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")]
        edges = ([32] if k == 0 else [], [32] if k + part >= len(lowered) else [])
        codes = np.concatenate([np.array(edges[0], np.uint32), codes, np.array(edges[1], np.uint32)])
        space = codes == 32
        any_letter |= not space.all()
        codes = codes[~(space & np.r_[False, space[:-1]])]
        hashed = codes * np.uint32(2654435761)
        for n in range(1, 4):
            if n > 1:
                hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(2246822519) + codes[n - 1:] * np.uint32(2654435761)
            if len(hashed):
                counts += np.bincount(hashed >> np.uint32(17), minlength=DIMS)
    return counts if any_letter else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used features and their TF-IDF values, of length one."""
    used = np.flatnonzero(counts)
    values = (1 + np.log(counts[used])) * idf[used]
    return used, values / max(np.linalg.norm(values), 1e-12)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x (features + bias)
    idf: np.ndarray
    temperature: float

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        used, values = weighted(counts, self.idf)
        chances = softmax((self.weights[:, used] @ values + self.weights[:, -1]) / self.temperature)
        best = int(np.argmax(chances))
        return self.languages[best], float(min(chances[best], 1.0))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(
    examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, rounds: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01,
) -> np.ndarray:
    """Weights from (features, values, class) by proximal follow-the-regularised-leader, one example at a time."""
    z, n = np.zeros((classes, DIMS + 1)), np.zeros((classes, DIMS + 1))

    def leader(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(rounds):
        for used, values, label in examples:
            at, x = np.r_[used, DIMS], np.r_[values, 1.0]
            zs, ns = z[:, at], n[:, at]
            w = leader(zs, ns)
            error = softmax(w @ x)
            error[label] -= 1
            g = error[:, None] * x
            z[:, at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[:, at] = ns + g * g
    return leader(z, n)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the smallest log loss, from a grid of 61 between 1/20 and 5.

    The targets leave one document in all to each wrong class, so that a faultless sample does not call for certainty.
    """
    if not len(labels):
        return 1.0
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + classes))
    target[np.arange(n), labels] += n / (n + classes)
    grid = np.geomspace(0.05, 5, 61)
    loss = [-(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(axis=1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = 6000) -> Model:
    """Model from labelled documents (non-null text and language).

    Document frequencies cover all of them. The weights come from about ``sample`` documents, evenly from each
    language and chosen by a hash of the id; every fifth of these sets the temperature. The learner is one task on
    that bounded sample; what reaches the driver is one row per feature and one model.
    """
    def frequencies(batches):
        letters, seen = worker_value(_letters), np.zeros(DIMS + 1, np.int64)
        for (texts,) in batches:
            for text in texts:
                counts = gram_counts(text, letters)
                if counts is not None:
                    seen[:DIMS] += counts > 0
                    seen[DIMS] += 1
        yield from ((int(i), int(seen[i])) for i in np.flatnonzero(seen))

    texts = labelled.select(F.col(text_col).alias("text"))
    df = np.zeros(DIMS + 1)
    for r in in_arrow(texts, "i int, n bigint", frequencies).groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1

    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().collect()}
    languages = sorted(sizes)
    if not languages or not df[DIMS]:
        return Model([], np.zeros((0, DIMS + 1)), idf, 1.0)
    chance = F.element_at(
        F.array(*[F.lit(min(1.0, sample / len(languages) / sizes[lang])) for lang in languages]),
        F.array_position(F.array(*[F.lit(lang) for lang in languages]), F.col(lang_col)).cast("int"),
    )
    order = F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(1 << 30))
    chosen = labelled.filter(order < chance * (1 << 30)).select(
        order.alias("order"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )

    def learned(batches):
        letters, examples = worker_value(_letters), []
        for columns in batches:
            for _, lang, text in zip(*columns):
                counts = gram_counts(text, letters)
                if counts is not None:
                    used, values = weighted(counts, idf)
                    examples.append((used.astype(np.int32), values.astype(np.float32), languages.index(lang)))
        kept = [e for k, e in enumerate(examples) if k % 5]
        weights = follow_the_leader(kept, len(languages))
        rest = examples[::5]
        logits = np.array([weights[:, u] @ v + weights[:, -1] for u, v, _ in rest]).reshape(-1, len(languages))
        yield weights.astype("<f4").tobytes(), calibrated(logits, np.array([e[2] for e in rest], int))

    one = chosen.repartition(1).sortWithinPartitions("order", "text")
    made = in_arrow(one, "weights binary, temperature double", learned).first()
    weights = np.frombuffer(made["weights"], "<f4").reshape(len(languages), -1).astype(np.float64)
    return Model(languages, weights, idf, made["temperature"])


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): every row of ``docs`` as a struct, with its language and the calibrated chance of it."""
    def rows(batches):
        letters = worker_value(_letters)
        for at, texts in batches:
            for row, text in zip(at, texts):
                yield row, *model.predict(gram_counts(text, letters))

    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_arrow(packed, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double", rows, flush=500)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 6000) -> DataFrame:
    """(id, held_out, lang_pred, score) of every whole text.

    Learned from rows that are not held out and have text and language. ``lang_pred`` is one of the learned languages,
    or ``und`` with score 0 if the text is null or has no letter, or if there was nothing to learn from. Repeated rows
    stay and are learned from as often; a null id is not held out. Other columns are ignored.
    """
    known = docs.filter(~held_out(id_col)).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    model = train(known, id_col, text_col, lang_col, sample)
    narrow = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return predicted(narrow, model, text_col).select(f"row.{id_col}", "row.held_out", "lang_pred", "score")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def of_known_language(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Pipeline stage: documents without a language go, that is without letters or with a chance below ``min_score``."""
    known = docs.filter(~held_out("doc_id")).filter("text is not null and lang is not null")
    found = predicted(docs, train(known, "doc_id", "text", "lang"))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")

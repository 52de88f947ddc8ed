"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text and normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Terms to begin with, when no labels say otherwise, and phrases in which a term means no harm.
SEED_TERMS = (
    "arsehole", "asshole", "bastard", "bitch", "clown", "cretin", "degenerate", "disgusting", "dumbass", "freak", "garbage", "idiot", "imbecile", "kill yourself", "loser", "lowlife",
    "moron", "pathetic", "pig", "retard", "scum", "shut up", "stupid", "subhuman", "trash", "vermin", "worthless",
)
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "trash bag", "garbage collection", "garbage collector", "guinea pig", "pig iron", "sore loser", "stupid question", "pond scum")
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g"}
SIGNS = {"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
#: Labelled training rows that the lexicon and the curve are fitted on, and terms learned from them.
SAMPLE_ROWS, LEARNED_TERMS = 20_000, 300
#: A learned term is in so many toxic texts, and so large a part of them, and its rate is so much higher there (log ratio).
LEAST_TEXTS, LEAST_PART, LEAST_WEIGHT, MOST_WEIGHT = 5, 0.03, 1.5, 8.0
#: Learned terms are words or, marked by *, beginnings of words of so many characters; a text counts a term so often at most.
STEMS, MOST_OF_A_TEXT = range(4, 9), 5
SEED_WEIGHT = 3.0
#: Bias and slopes of log(1 + weight) and log(1 + weight per 100 words), where there is nothing to fit them on.
DEFAULT_CURVE = (-3.0, 0.7, 1.3)


class Model(NamedTuple):
    weights: dict[str, float]
    curve: tuple[float, float, float]


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """One character for one: case, accents, compatibility forms, look-alikes, digits and signs all fold to a-z.

    `l` and `1` look alike, so both fold to `i`, in the lexicon too.
    """
    out = {}
    for at in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0xFF00, 0xFF5F), *range(0x1D400, 0x1D800)]:
        base = unicodedata.normalize("NFKD", chr(at)).lower()[:1]
        base = LOOK_ALIKES.get(base, base)
        base = SIGNS.get(base, base)
        if base and base != chr(at):
            out[at] = base
    return out


#: Marks that don't show or sit on the letter before, such as zero-width characters and combining accents.
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")


def seen(text: str) -> str:
    """The text without marks that would part or dress up the letters of a word."""
    return _UNSEEN.sub("", text)


def fold(text: str) -> str:
    return text.translate(folding())


def automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    """Payloads: (length, weight of the whole word, weight where anything may follow), the weights None for an exception phrase.

    Of terms that fold to one string the largest weight holds.
    """
    payloads: dict[str, tuple[int, float | None, float | None]] = {}
    for term, weight in weights.items():
        bare = fold(seen(term.rstrip("*")))
        _, whole, begun = payloads.get(bare, (0, 0.0, 0.0))
        payloads[bare] = (len(bare), max(whole, weight), max(begun, weight) if term.endswith("*") else begun)
    payloads |= {fold(phrase): (len(phrase), None, None) for phrase in EXCEPTIONS}
    found = ahocorasick.Automaton()
    for bare, payload in payloads.items():
        found.add_word(bare, payload)
    found.make_automaton()
    return found


def weigh(text: str, terms: ahocorasick.Automaton) -> tuple[float, int]:
    """The weight of the terms that stand as whole words (or begin one, as marked) outside of exception phrases, and the number of words."""
    text = seen(text)
    hits, excused = [], []
    for last, (length, whole, begun) in terms.iter(fold(text)):
        first, end = last - length + 1, last + 1
        if first and text[first - 1].isalnum():
            continue
        alone = end == len(text) or not text[end].isalnum()
        if whole is None:
            excused += [(first, end)] if alone else []
        elif weight := whole if alone else begun:
            hits.append((first, end, weight))
    free = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in excused)] if excused else hits
    return sum(h[2] for h in free), max(len(text.split()), 1)


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / words)])


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(hash, text, toxic): the distinct texts of at most `rows` labelled ids, the first by a hash of doc_id, toxic if any label of
    a text says so. The ids alone are sorted and broadcast; copies are dropped before and while they are shuffled."""
    learnt = labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    picked = learnt.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text is not null")
    return labelled.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, counts, totals = Counter(), (Counter(), Counter()), [0, 0]
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            # Folded, so that the spellings of a word count as one; what may stand for a letter is cut off a word's ends first.
            words, terms = Counter(fold(w.strip(".,;:!?\"'()[]*%#&$|")) for w in seen(text).split()), Counter()
            for word, n in words.items():
                if 2 < len(word) < 40:
                    terms[word] += n
                    for k in STEMS:
                        if len(word) > k:
                            terms[word[:k] + "*"] += n
            if toxic:
                texts.update(terms.keys())
            totals[toxic] += words.total()
            counts[toxic].update({t: min(n, MOST_OF_A_TEXT) for t, n in terms.items()})
        every = list(counts[0] | counts[1])
        yield pd.DataFrame({"term": every, "texts": [texts[t] for t in every], "tox": [counts[1][t] for t in every], "rest": [counts[0][t] for t in every]})
        yield pd.DataFrame({"term": [""], "texts": 0, "tox": totals[1], "rest": totals[0]})  # the words of all texts


def _without_kin(ranked: list[tuple[str, float]]) -> dict[str, float]:
    """The best of terms that begin one another."""
    kept: dict[str, float] = {}
    for term, weight in ranked:
        bare = term.rstrip("*")
        if not any(bare.startswith(k.rstrip("*")) or k.startswith(bare) for k in kept):
            kept[term] = weight
    return kept


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon weights and score curve from a sample of at most `rows` labelled training rows, rows with held-out ids never among them.

    Counting, selecting and weighing run as Spark jobs over the sample's distinct texts, of which there are no more than rows;
    the driver gets LEARNED_TERMS terms and two numbers a text. Seed terms keep their weight unless the labels speak against them. Without both labels, the seed model holds.
    """
    sample = whole = _sample(docs, labels, rows).persist()
    try:
        if sample.count() > rows:  # ids with several texts
            sample = sample.join(F.broadcast(sample.select("hash").orderBy("hash").limit(rows)), "hash", "left_semi")
        classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n_tox, n_rest = classes.get(1, 0), classes.get(0, 0)
        seeds = dict.fromkeys(SEED_TERMS, SEED_WEIGHT)
        if not n_tox or not n_rest:
            return Model(seeds, DEFAULT_CURVE)
        counts = sample.select("text", "toxic").mapInPandas(_count_terms, "term string, texts long, tox long, rest long")
        counts = materialise(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("texts", "tox", "rest")]), "terms")
        words = counts.filter("term = ''").first()
        weight = F.log((F.col("tox") + 0.5) / (words["tox"] + 1.0)) - F.log((F.col("rest") + 0.5) / (words["rest"] + 1.0))
        weighed = counts.filter("term <> ''").withColumn("weight", weight).withColumn("gain", F.col("weight") * F.col("tox"))
        told = weighed.filter((F.col("texts") >= max(LEAST_TEXTS, LEAST_PART * n_tox)) & (F.col("weight") >= LEAST_WEIGHT))
        ranked = told.orderBy(F.desc("gain"), F.desc(F.length(F.regexp_replace("term", r"\*$", ""))), "term").limit(LEARNED_TERMS * len(STEMS)).select("term", "weight").collect()
        learned = _without_kin([(r["term"], min(r["weight"], MOST_WEIGHT)) for r in ranked])
        folded = {fold(t): t for t in SEED_TERMS}
        harmless = {folded[r["term"]] for r in weighed.filter(F.col("term").isin(*folded) & (F.col("weight") < 0.5)).collect()}
        learned = dict(list(learned.items())[:LEARNED_TERMS])
        weights = learned | {t: w for t, w in seeds.items() if t not in harmless and not any(fold(t).startswith(k.rstrip("*")) for k in learned)}
        rows_seen = sample.select("text", "toxic").mapInPandas(_Weigher(Model(weights, DEFAULT_CURVE), ["toxic"]), "toxic int, weight double, words long").toPandas()
        return Model(weights, _fit_curve(features(rows_seen["weight"].to_numpy(), rows_seen["words"].to_numpy()), rows_seen["toxic"].to_numpy() == 1))
    finally:
        whole.unpersist()


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


class _Weigher:
    """For mapInPandas: the columns to keep, then weight and words of each text."""

    def __init__(self, model: Model, keep: list[str], text: str = "text"):
        self.model, self.keep, self.text = model, keep, text

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = automaton(self.model.weights)
        for batch in batches:
            found = [weigh(t or "", terms) for t in batch[self.text]]
            yield batch[self.keep].assign(weight=[w for w, _ in found], words=[n for _, n in found])


class _Scorer(_Weigher):
    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in super().__call__(batches):
            z = features(batch["weight"].to_numpy(float), batch["words"].to_numpy(float)) @ np.array(self.model.curve)
            yield batch[self.keep].assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))), weight=batch["weight"].astype(float))


def score_texts(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all of docs) with _toxicity (0 to 1) and _toxic_weight, whole texts, no shuffle.

    A null or empty text scores as a text without a term. Repeated rows score alike; texts of any length are read whole.
    """
    keep = docs.columns if keep is None else keep
    ids = [f"k{n}" for n in range(len(keep))]
    body = ids[keep.index(text)] if text in keep else "text"
    kept = docs.select(*[F.col(c).alias(i) for i, c in zip(ids, keep, strict=True)], *([] if text in keep else [F.col(text).cast("string").alias("text")]))
    schema = "".join(f"{i} {kept.schema[i].dataType.simpleString()}, " for i in ids)
    scored = kept.mapInPandas(_Scorer(model, ids, body), f"{schema}score double, weight double")
    return scored.select(*[F.col(i).alias(c) for i, c in zip(ids, keep, strict=True)], F.col("score").alias("_toxicity"), F.col("weight").alias("_toxic_weight"))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, weight.

    Only labels of rows that aren't held out are learnt from; doc_id, lang, source and labels are no inputs of a score.
    Null ids are not held out but match no label; empty tables give no rows, and no labels the seed model.
    """
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels, rows), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"), F.col("_toxic_weight").alias("weight")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, with their own columns."""
    return score_texts(docs, fit(docs, labels)).filter(F.col("_toxicity") < threshold).select(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

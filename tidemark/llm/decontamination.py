"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .shingles import SHINGLE_WORDS, WORD, batch_shingles, mix, shingle_hashes

#: The part of an item's shingles that a document must hold.
CONTAINMENT = 0.8
#: Minima per window. A window holds an item whole and is at most four times as long, so that an item with 0.8 of its shingles
#: there has a Jaccard similarity of at least 0.8 / 4.2 with it; all 48 minima differ with probability (1 - 0.19)^48 = 4e-5,
#: and of the one or two windows that hold a passage whole both must.
MINIMA = 48
#: Items are sent to all executors while they have at most so many minima, of 8 bytes, and their texts no more bytes than
#: those; beyond it, minima are joined. Either way the same pairs are found.
MOST_SENT = 1_000_000
#: 64-bit words of the filter (16 MB) that spares minima of documents the join where no item has the like.
FILTER_WORDS = 1 << 21
#: Shingles of which minima are taken at a time, to stay in the processor's cache, and shingles of a group of documents.
CHUNK, GROUP = 1 << 14, 1 << 16
#: Odd multipliers: each reorders the 32-bit shingle hashes, which are mixed well already.
_FACTORS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def size_class(n: int) -> int:
    """Items of 2^c to 2^(c+1) - 1 shingles are class c; their windows are 2^(c+2) shingles long, one every 2^(c+1)."""
    return max(n, 1).bit_length() - 1


def item_minima(shingles: np.ndarray) -> np.ndarray:
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    return np.array([(short * f).min() for f in _FACTORS], np.uint64)


def item_keys(shingles: np.ndarray) -> np.ndarray:
    """The minima of an item, told apart by size class and number."""
    return _keyed(item_minima(shingles), np.arange(MINIMA), size_class(len(np.unique(shingles))))


def _keyed(minima: np.ndarray, nth: np.ndarray, cls: int) -> np.ndarray:
    return mix(minima + (nth.astype(np.uint64) * np.uint64(64) + np.uint64(cls)) * np.uint64(0x9E3779B97F4A7C15))


def window_keys(shingled: list[np.ndarray], classes: list[int], passes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the minima of all windows of documents, and the number of the document of each.

    Minima of blocks as long as the smallest class's stride are taken once, for all documents together; longer windows are
    minima of those. passes[n, top], if given, tells which leading 16 bits of the n-th minimum are worth a key.
    """
    step, longest = 2 << min(classes), 2 << max(classes)
    padded, of = [], []
    for n, shingles in enumerate(shingled):
        if len(shingles):
            short = (shingles >> np.uint64(32)).astype(np.uint32)
            padded += [short, np.repeat(short[-1:], -len(short) % longest)]
            of.append(np.full(-(-len(short) // longest) * (longest // step), n))
    if not of:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    across, of = np.concatenate(padded).reshape(-1, step).T, np.concatenate(of)
    columns = max(CHUNK // step, 1)
    level = np.empty((MINIMA, across.shape[1]), np.uint32)
    for at in range(0, across.shape[1], columns):
        part = np.ascontiguousarray(across[:, at : at + columns])  # a block is a column, so that minima are taken a row at a time
        for n, factor in enumerate(_FACTORS):
            level[n, at : at + columns] = (part * factor).min(axis=0)
    keys, owners = [], []
    for cls in range(min(classes), max(classes) + 1):
        if cls in classes:
            following = np.where(np.r_[of[1:] == of[:-1], False], np.c_[level[:, 1:], level[:, -1:]], level)
            minima = np.minimum(level, following)
            nth, block = np.nonzero(passes[np.arange(MINIMA)[:, None], minima >> np.uint32(16)]) if passes is not None else (x.ravel() for x in np.indices(minima.shape))
            keys.append(_keyed(minima[nth, block].astype(np.uint64), nth, cls))
            owners.append(of[block])
        level, of = np.minimum(level[:, ::2], level[:, 1::2]) if cls < max(classes) else level, of[::2]
    return np.concatenate(keys), np.concatenate(owners)


def contained(item: str, text_shingles: np.ndarray, text: str) -> float:
    """The part of the item's distinct shingles that the text holds; hashes choose what the words then confirm."""
    words = WORD.findall(item.lower())
    own = {" ".join(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1)}
    places = np.flatnonzero(np.isin(text_shingles, shingle_hashes(item)))
    if not own or len(np.unique(text_shingles[places])) < CONTAINMENT * len(own):
        return 0.0
    body = WORD.findall(text.lower())
    return len(own & {" ".join(body[at : at + SHINGLE_WORDS]) for at in places}) / len(own)


class _Search:
    """For mapInPandas over (doc_id, text): candidates by the items' minima, verified at once, as the text is at hand."""

    def __init__(self, items: list[tuple[object, str]]):
        shingled = [(i, t, shingle_hashes(t)) for i, t in items]
        self.items = [(i, t) for i, t, s in shingled if len(s)]
        keys = [item_keys(s) for _, _, s in shingled if len(s)]
        self.classes = sorted({size_class(len(np.unique(s))) for _, _, s in shingled if len(s)})
        keys_of = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys_of, kind="stable")
        self.keys, self.owner = keys_of[order], (order // MINIMA)
        self.passes = np.zeros((MINIMA, 1 << 16), bool)
        for _, _, s in shingled:
            if len(s):
                self.passes[np.arange(MINIMA), item_minima(s) >> np.uint64(16)] = True

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts, shingled in _groups(batches) if self.items else ():
            keys, of = window_keys(shingled, self.classes, self.passes)
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            found = []
            for doc, n in sorted({(int(of[k]), int(o)) for k in np.flatnonzero(high > low) for o in self.owner[low[k] : high[k]]}):
                item_id, item = self.items[n]
                if (part := contained(item, shingled[doc], texts[doc])) >= CONTAINMENT:
                    found.append((ids[doc], item_id, part))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "containment"])


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str], list[np.ndarray]]]:
    """Documents (ids, texts, shingles) in groups of about GROUP shingles, or one longer document."""
    for batch in batches:
        ids, texts, shingled, size = [], [], [], 0
        for doc_id, text, shingles in zip(batch["doc_id"], batch["text"], batch_shingles(batch["text"]), strict=True):
            if size and size + len(shingles) > GROUP:
                yield ids, texts, shingled
                ids, texts, shingled, size = [], [], [], 0
            ids.append(doc_id), texts.append(text), shingled.append(shingles)
            size += len(shingles)
        if ids:
            yield ids, texts, shingled


def _document_keys(classes: list[int], sieve: Broadcast):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = sieve.value
        for batch in batches:
            numbered = pd.DataFrame({"doc_id": range(len(batch)), "text": batch["text"]})
            for at, _, shingled in _groups([numbered]):
                found, of = window_keys(shingled, classes)
                passed = (words[found >> np.uint64(43)] >> ((found >> np.uint64(37)) & np.uint64(63))) & np.uint64(1) == 1
                yield batch[["doc_id", "hash"]].iloc[np.array(at)[of[passed]]].assign(key=found[passed].view(np.int64)).drop_duplicates()

    return keys


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit for each key's leading 27 bits, in FILTER_WORDS words, whatever the number of keys."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 37) & 63 as int))")
    found = keys.groupBy(F.shiftrightunsigned("key", 43).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def _item_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
            shingles = shingle_hashes(text or "")
            if len(shingles):
                found = np.unique(item_keys(shingles))
                yield pd.DataFrame({"item_id": item_id, "key": found.view(np.int64), "class": size_class(len(np.unique(shingles)))})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        part = [contained(i, shingle_hashes(t), t) for t, i in zip(batch["text"], batch["item_text"], strict=True)]
        yield batch[["doc_id", "item_id"]].assign(containment=part).query("containment >= @CONTAINMENT")


def find_contaminated(docs: DataFrame, items: DataFrame, most_sent: int = MOST_SENT, nameless: bool = False) -> DataFrame:
    """(doc_id, item_id, containment): the items of which a document holds 0.8 or more of the distinct five-word shingles.

    docs has (doc_id long, text), items (item_id, text). Windows as long as an item's size class allows are searched for the
    item's minima, whatever the length of the document; containment is counted over the whole document. Items and documents of
    fewer than five words have no shingles and take no part; null texts and item ids neither, nor null doc_ids unless nameless
    is set: then they share a null doc_id in the result. Rows that share an id give a pair once, with the largest part.

    While the items are small (measured first), they go to all executors and nothing of the documents is shuffled. Beyond
    that, documents' minima are joined to them, those that no item has left out first by a filter of fixed size, and the
    pairs' texts are joined back by id and text hash to be verified.
    """
    if nameless:
        unnamed = docs.filter(F.col("doc_id").isNull()).select(F.xxhash64("text").alias("doc_id"), "text")
        by_item = find_contaminated(unnamed, items, most_sent).groupBy("item_id").agg(F.max("containment").alias("containment"))
        return find_contaminated(docs, items, most_sent).unionByName(by_item.withColumn("doc_id", F.lit(None).cast("long")))
    docs, items = docs.select("doc_id", "text").dropna(), items.select("item_id", "text").dropna()
    id_type = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {id_type}, containment double"
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    items = items.dropDuplicates(["item_id", "text"])
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n * MINIMA <= most_sent and size <= 8 * most_sent:
        found = docs.mapInPandas(_Search([tuple(r) for r in items.collect()]), schema)
        return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
    keys = materialise(items.mapInPandas(_item_keys, f"item_id {id_type}, key long, class int"), "item-keys")
    classes = sorted(r[0] for r in keys.select("class").distinct().collect()) or [0]
    docs = docs.withColumn("hash", F.xxhash64("text"))
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(keys))
    met = docs.mapInPandas(_document_keys(classes, sieve), "doc_id long, hash long, key long").join(keys, "key").select("doc_id", "hash", "item_id").distinct()
    met = materialise(met, "met")
    once = docs.join(met.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
    texts = met.join(once, ["doc_id", "hash"]).join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "text", "item_id", "item_text")
    return texts.mapInPandas(_verify, schema).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, nameless: bool = False) -> DataFrame:
    """The rows of docs that hold no item, with their own columns. Rows with a null doc_id are dropped too if nameless is set,
    else they stay.

    Rows are known by a 64-bit hash of their text, which alone decides whether they hold an item: clean rows that share the
    doc_id of a contaminated one stay.
    """
    searched = docs if nameless else docs.filter(F.col("doc_id").isNotNull())
    texts = searched.dropna(subset=["text"]).select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = materialise(find_contaminated(texts, items).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    leaking = F.xxhash64(docs["text"]) == leaks["_leak"]
    return docs.join(leaks, leaking if nameless else leaking & docs["doc_id"].isNotNull(), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)


#: Exact containment, item by item; a number for each row keeps the texts out of the joins.
ORACLE = r"""
WITH items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
docs AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
of_items AS (SELECT DISTINCT item, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM items),
of_docs AS (SELECT DISTINCT doc, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM docs),
sizes AS (SELECT item, count(*) AS size FROM of_items GROUP BY 1),
met AS (SELECT doc, item, count(*) AS held FROM of_docs JOIN of_items USING (shingle) GROUP BY 1, 2)
SELECT doc_id, item_id, max(held / size::DOUBLE) AS containment
FROM met JOIN sizes USING (item) JOIN items USING (item) JOIN docs USING (doc) WHERE held >= 0.8 * size GROUP BY 1, 2
"""

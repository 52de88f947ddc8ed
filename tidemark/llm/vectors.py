"""Approximate maximum inner product search: coarse centres, anisotropic product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

NEAREST = 20
#: Every so many vec_ids is a query.
QUERY_EVERY = 20
#: Coarse centres.
COARSE = 256
#: Dimensions per code of four bits, and sweeps of encoding.
SUBSPACE, CODES, SWEEPS = 2, 16, 3
#: Cosine from which on a dot product matters: it sets how much more the parallel part of the residual weighs.
THRESHOLD = 0.2
#: Vectors that the codebooks are fitted on; all vectors are indexed. Rounds of fitting.
SAMPLE, ROUNDS = 10_000, 12
#: Candidates of a query that are scored exactly.
RERANK = 300
#: Vectors of a cell of the scan, in the mean, and cells at most. A query scans the cells whose centres it likes best, as many as
#: find RECALL of the neighbours of PROBED sample vectors in the sample: few where vectors lie in clusters, all where they don't.
CELL, MOST_CELLS, RECALL, PROBED = 1 << 16, 1024, 0.98, 200
#: Queries and vectors of a scanned block at most. Tables of some size have LEAST_BLOCKS, of LEAST vectors or more.
QUERY_BLOCK, VECTOR_BLOCK, LEAST_BLOCKS, LEAST = 4096, 1 << 18, 8, 2048


class Codebooks(NamedTuple):
    """coarse: COARSE x dimensions; centres: subspaces x CODES x SUBSPACE; weight: of the parallel part of a residual, 1 or more.

    A vector is a coarse centre and, times the length that is left, a shape given by its codes.
    """

    coarse: np.ndarray
    centres: np.ndarray
    weight: float


def _parts(x: np.ndarray) -> np.ndarray:
    """rows x subspaces x SUBSPACE, filled up with zeros."""
    pad = -x.shape[1] % SUBSPACE
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUBSPACE)


def _closest(x: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    return ((coarse**2).sum(1)[None, :] - 2 * x @ coarse.T).argmin(1)


def _shapes(x: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coarse centres, lengths left, shapes and directions; directions and shapes in parts."""
    near = _closest(x, coarse)
    left = x - coarse[near]
    length = np.linalg.norm(left, axis=1)
    return near, length, _parts(left / np.maximum(length, 1e-30)[:, None]), _parts(x / np.linalg.norm(x, axis=1)[:, None])


def _descend(parts: np.ndarray, u: np.ndarray, centres: np.ndarray, weight: float) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + (weight - 1) (r.u)^2, r the residual of the shape and u the vector's direction."""
    apart = ((parts[:, :, None, :] - centres[None]) ** 2).sum(-1)
    along = ((parts[:, :, None, :] - centres[None]) * u[:, :, None, :]).sum(-1)
    codes = apart.argmin(-1)
    rows = np.arange(len(parts))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(SWEEPS):
        for m in range(parts.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (apart[:, m] + (weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes


def encode(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coarse centres, lengths and codes of vectors."""
    near, length, parts, u = _shapes(x, books.coarse)
    return near.astype(np.int32), length.astype(np.float32), _descend(parts, u, books.centres, books.weight).astype(np.uint8)


def fit(sample: np.ndarray, seed: int = 7) -> Codebooks:
    """Coarse centres by k-means, then score-aware codebooks of the shapes left: encoding alternates with the centres that
    minimise the anisotropic loss for the codes at hand."""
    n, dims = sample.shape
    rng = np.random.default_rng(seed)
    coarse = sample[rng.choice(n, COARSE, replace=n < COARSE)]
    for _ in range(ROUNDS):
        near = _closest(sample, coarse)
        counts = np.bincount(near, minlength=COARSE)
        sums = np.zeros_like(coarse)
        np.add.at(sums, near, sample)
        coarse = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], coarse)
    weight = max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    _, _, parts, u = _shapes(sample, coarse)
    subspaces = parts.shape[1]
    centres = np.stack([parts[rng.choice(n, CODES, replace=n < CODES), m] for m in range(subspaces)]) + rng.normal(0, 1e-6, (subspaces, CODES, SUBSPACE))
    for _ in range(ROUNDS):
        codes = _descend(parts, u, centres, weight)
        along = ((parts - centres[np.arange(subspaces), codes]) * u).sum(-1)
        total = along.sum(1)
        for m in range(subspaces):
            want = total - along[:, m] + (parts[:, m] * u[:, m]).sum(-1)  # what the centre's product with u should be
            for j in range(CODES):
                if len(own := np.flatnonzero(codes[:, m] == j)):
                    v = u[own, m]
                    left = len(own) * np.eye(SUBSPACE) + (weight - 1) * v.T @ v
                    centres[m, j] = np.linalg.solve(left, parts[own, m].sum(0) + (weight - 1) * v.T @ want[own])
            moved = ((parts[:, m] - centres[m, codes[:, m]]) * u[:, m]).sum(-1)
            total, along[:, m] = total - along[:, m] + moved, moved
    return Codebooks(coarse, centres, weight)


def cell_centres(sample: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Centres by k-means; the mean alone if there is one cell."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=len(sample) < cells)]
    for _ in range(ROUNDS):
        near = _closest(sample, centres)
        counts, sums = np.bincount(near, minlength=cells), np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def calibrated(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many cells a query must scan so that RECALL of the neighbours of sample vectors, within the sample, lie in them."""
    if len(centres) == 1 or len(sample) <= k:
        return len(centres)
    asked = sample[:PROBED]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    found = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    need = np.take_along_axis(place, _closest(sample, centres)[found], 1).ravel()
    return min(int(np.quantile(need, RECALL, method="higher")) + 1, len(centres))


class _Encoder:
    def __init__(self, books: Codebooks, centres: np.ndarray):
        self.books, self.centres = books, centres

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"]).astype(np.float64)
                near, length, codes = encode(x, self.books)
                packed = codes[:, ::2] | (np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))[:, 1::2] << 4)
                yield batch[["vec_id"]].assign(near=near, length=length, code=[row.tobytes() for row in packed], cell=_closest(x, self.centres).astype(np.int32))


class _Probe:
    """For mapInPandas over queries: the cells that each scans."""

    def __init__(self, centres: np.ndarray, probes: int):
        self.centres, self.probes = centres, probes

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                liked = np.argsort(-(np.stack(batch["vector"]).astype(np.float64) @ self.centres.T), axis=1, kind="stable")[:, : self.probes]
                yield batch[["vec_id", "vector"]].assign(cells=list(liked.astype(np.int32)))


class _Scan:
    """For cogrouped blocks of queries and codes: the best of the block for each query by table sums, `most` of them."""

    def __init__(self, books: Codebooks, most: int | None):
        self.books, self.most = books, most

    def __call__(self, queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(codes):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "rough": pd.Series(dtype="float64")})
        codes = codes.sort_values("vec_id")  # a stable choice among equal scores then keeps smaller ids
        packed = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
        subspaces = len(self.books.centres)
        pairs, ids = packed.shape[1], codes["vec_id"].to_numpy()
        vectors = _parts(np.stack(queries["vector"]).astype(np.float64))
        tables = np.einsum("qmd,mcd->qmc", vectors, self.books.centres).astype(np.float32)
        if subspaces % 2:
            tables = np.concatenate([tables, np.zeros((len(tables), 1, CODES), np.float32)], 1)
        coarse = (np.stack(queries["vector"]).astype(np.float64) @ self.books.coarse.T).astype(np.float32)
        near, length = codes["near"].to_numpy(), codes["length"].to_numpy(np.float32)
        by_pair = np.ascontiguousarray(packed.T)
        out_q, out_v, out_s = [], [], []
        for query_id, base, table in zip(queries["vec_id"].to_numpy(), coarse, tables, strict=True):
            # Two codes share a byte: one table of 256 sums for both halves the look-ups.
            look_up = (table[0::2, None, :] + table[1::2, :, None]).reshape(pairs, CODES * CODES)
            rough = np.zeros(len(ids), np.float32)
            for m in range(pairs):
                rough += look_up[m][by_pair[m]]
            rough = base[near] + length * rough
            if self.most is not None and len(ids) > self.most:
                least = np.partition(rough, -self.most)[-self.most]
                best = np.r_[np.flatnonzero(rough > least), np.flatnonzero(rough == least)][: self.most]
            else:
                best = np.arange(len(ids))
            out_q.append(np.full(len(best), query_id)), out_v.append(ids[best]), out_s.append(rough[best])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "rough": np.concatenate(out_s).astype(np.float64)})


def _rerank(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): inner products in double precision, summed by Spark in the order of the components."""
    product = F.aggregate(F.zip_with("query", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("query_id", "vec_id", product.alias("score"))


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: a key, and a vector that isn't null or zero nor holds a null, NaN or infinity."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & some)


def nearest(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, every: int = QUERY_EVERY, rerank: int | None = RERANK, probes: int | None = None, cell: int = CELL
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vec_id divisible by `every`, the k rows of largest inner product, not itself.

    The codebooks are fitted on SAMPLE vectors, the first by a hash of their ids; every vector is encoded. Vectors lie in cells of
    about `cell` vectors, and a query scans `probes` of them (default: see calibrated), four bits per two dimensions; the
    `rerank` best are scored on the original vectors, each block of a cell sending its likely share of them and four deviations
    more, of one cell of several 3 k at least. With rerank=None and probes=MOST_CELLS all rows are scored and the result is
    exact. Ties go to the smaller vec_id. Rows that aren't usable take no part, nor do vectors of a length other than the
    commonest; rows that repeat a vec_id count once, with the smallest vector; fewer candidates than k give fewer rows. Other
    columns are ignored.

    Equal vectors have equal scores, so only the k + 1 smallest ids of each can be found, and only they are scanned; Spark
    limits the group before it shuffles. Codes go to the queries that scan their block, QUERY_BLOCK at a time, and queries to
    blocks of up to VECTOR_BLOCK codes: groups of bounded size, and a code is copied once for so many queries of its cell.
    """
    rows = usable(vectors, key, vector).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = materialise(rows, "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    rows = rows.filter(F.size("vector") == lengths["n"])
    sample = np.stack(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]).astype(np.float64)
    books, centres = fit(sample), cell_centres(sample, min(max(math.ceil(lengths["count"] / cell), 1), MOST_CELLS))
    probes = calibrated(sample, centres, k) if probes is None else min(probes, len(centres))

    alike = rows.withColumn("copy", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("copy") <= k + 1)
    codes = materialise(alike.mapInPandas(_Encoder(books, centres), "vec_id long, near int, length float, code binary, cell int"), "codes")
    queries = rows.filter(F.col("vec_id") % every == 0)
    n_queries = queries.count()
    if not n_queries:
        return empty
    query_blocks = math.ceil(n_queries / QUERY_BLOCK)
    # A row per cell, MOST_CELLS at most: the numbers of its blocks.
    sizes = sorted((r["cell"], r["count"]) for r in codes.groupBy("cell").count().collect())
    cells, blocks = [], 0
    for number, size in sizes:
        parts = max(math.ceil(size / VECTOR_BLOCK), min(math.ceil(LEAST_BLOCKS / len(centres)), math.ceil(size / LEAST)))
        cells.append((number, blocks, parts))
        blocks += parts
    cells = F.broadcast(rows.sparkSession.createDataFrame(cells, "cell int, first int, parts int"))

    def part(n) -> Column:
        return F.pmod(F.xxhash64("vec_id"), n).cast("int")

    asking = queries.mapInPandas(_Probe(centres, probes), "vec_id long, vector array<double>, cells array<int>")
    left = asking.select("vec_id", "vector", part(F.lit(query_blocks)).alias("qb"), F.explode("cells").alias("cell")).join(cells, "cell")
    left = left.select("vec_id", "vector", "qb", F.explode(F.expr("sequence(first, first + parts - 1)")).alias("cb"))
    right = codes.join(cells, "cell").withColumns({"cb": F.col("first") + part(F.col("parts")), "qb": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))}).drop("cell", "first", "parts")
    most = None
    if rerank is not None:
        # Blocks of a cell are dealt by a hash, so the best ones of a query fall evenly on them.
        share = rerank / max(blocks * probes / len(centres), 1)
        most = min(rerank, max(math.ceil(share + 4 * math.sqrt(share) + 4), 3 * k if len(centres) > 1 else 0))
    scan = _Scan(books, most)
    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(lambda q, c: scan(q, c), "query_id long, vec_id long, rough double")
    best = met.filter("query_id <> vec_id")
    if rerank is not None:
        best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id"))).filter(F.col("n") <= rerank)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    scored = _rerank(best.select("query_id", "vec_id").join(rows, "vec_id").join(asked, "query_id"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: Every row scored against every query: where the index finds all neighbours, as it does at sf0.01, the results agree.
ORACLE = """
WITH usable AS (
  SELECT vec_id::BIGINT AS vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1),
alike AS (
  SELECT * FROM usable WHERE len(v) = (SELECT len(v) FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda s, x: s + x) AS score
  FROM alike q JOIN alike c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""

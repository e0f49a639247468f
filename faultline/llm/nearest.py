"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Method. Vectors are scaled to length one, centred, and rotated by a matrix learnt on a sample of about ``SAMPLE`` rows
(principal axes, then iterative quantisation: the rotation that brings the sample closest to the corners of a cube); the
signs of ``CODE_BITS`` coordinates are the code. A code is split into substrings, each indexed by value. By the
pigeonhole principle, a code within the radius differs from the query's in few bits of some substring, so looking up all
values that near in every substring finds every code within the radius; exact distances of codes drop the others, and the cosine
of the original vectors in double precision ranks what is left. The radius is learnt too: the distance of codes that covers the
share ``COVER`` of the sample's own true neighbours, so that vectors whose neighbours are far get a wide one.
A query with fewer than k codes in its radius looks at all rows of the block, so it never comes back short.

Scale. Rows are dealt to blocks of about ``BLOCK`` rows, each with its own index, and queries to blocks of about
``QUERIES``; every block of rows meets every block of queries in a task that holds two blocks and gives k rows a query. Equal vectors
are one row, with their k + 1 smallest identifiers, so copies fill no block.

Defined results. Vectors that are null, zero or hold null or non-finite components take no part, neither do null
identifiers or vectors of another length than most. A query is not its own candidate; repeated rows of one identifier count once,
by their smallest vector. Ties go to the smaller identifier. No rows, or no queries, give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import column

CODE_BITS, SUBSTRING = 64, 8
SAMPLE = 8_000
COVER = 0.97
BLOCK, QUERIES = 16_384, 2_048
SALTS = 64


class Codes:
    """Centre, rotation and radius learnt from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 30, seed: int = 5):
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        x = sample - self.centre
        dim = x.shape[1]
        # More bits than dimensions come from further rotations; axes beyond the bits are left out.
        random = np.random.default_rng(seed)
        axes = np.linalg.eigh(x.T @ x)[1].T[::-1]  # principal axes, largest first
        self.rotations = []
        left = CODE_BITS
        while left > 0:
            used = min(left, dim)
            basis = axes[:used].T
            v = x @ basis
            r = np.linalg.qr(random.standard_normal((used, used)))[0]
            for _ in range(rounds if len(x) else 0):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            self.rotations.append(basis @ r)
            left -= used
        self.radius = CODE_BITS
        if len(sample) > k:
            codes = self.encode(sample)
            probe = np.arange(0, len(sample), -(-len(sample) // 1000))
            likeness = sample[probe] @ sample.T  # 1,000 rows at most
            likeness[np.arange(len(probe)), probe] = -np.inf
            near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
            far = hamming(codes[probe][:, None], codes[near]).ravel()
            self.radius = int(np.quantile(far, COVER, method="higher"))

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        bits = np.concatenate([(unit - self.centre) @ r > 0 for r in self.rotations], axis=1)
        return np.packbits(bits, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes (last axis: bytes)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


_NEAR = [np.array([sum(1 << b for b in bits) for bits in combinations(range(SUBSTRING), r)], np.uint8) for r in range(SUBSTRING + 1)]


class MultiIndex:
    """Every substring of the codes indexed by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows, self.bounds = [], []
        for s in range(codes.shape[1]):
            self.rows.append(np.argsort(codes[:, s], kind="stable"))
            self.bounds.append(np.searchsorted(codes[self.rows[-1], s], np.arange(257)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes are within ``radius`` of ``code``."""
        parts = len(self.rows)
        # With radius = parts * r + a, one of the first a + 1 substrings is within r, or another within r - 1.
        r, a = divmod(radius, parts)
        found = np.zeros(len(self.codes), bool)
        for s in range(parts):
            reach = r if s <= a else r - 1
            for flips in _NEAR[: min(reach, SUBSTRING) + 1]:
                for value in (code[s] ^ flips).tolist():
                    found[self.rows[s][self.bounds[s][value] : self.bounds[s][value + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[hamming(self.codes[rows], code) <= radius]


def _sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unpacked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision and their lengths, each vector scaled by a power of two that brings its largest component near 1.

    The scaling is exact and changes no cosine; without it lengths of extreme vectors would overflow, or vanish.
    """
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    x = np.ldexp(x, -exponent[:, None])
    return x, np.linalg.norm(x, axis=1)


def _search(codes, k: int) -> Callable:
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        own: Codes = codes.value
        out: list[tuple[int, int, float]] = []
        if len(rows) and len(queries):
            x, size = _unpacked(rows["vector"])
            unit = x / size[:, None]
            index = MultiIndex(own.encode(unit))
            q, q_size = _unpacked(queries["vector"])
            q_codes = own.encode(q / q_size[:, None])
            ids = rows["ids"].tolist()
            for i, query in enumerate(queries["query_id"].tolist()):
                near = index.within(q_codes[i], own.radius)
                if len(near) <= k:
                    near = np.arange(len(x))
                score = (x[near] @ q[i]) / (size[near] * q_size[i])
                if len(near) > k + 1:
                    # One more than k, as the query's own row may be among them, and all that tie with the last.
                    least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    held = score >= least
                    near, score = near[held], score[held]
                found = [(-s, v) for s, row in zip(score.tolist(), near.tolist(), strict=True) for v in ids[row] if v != query]
                out += [(query, v, -s) for s, v in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the k nearest found of every query, by id.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    sound = (
        vectors.select(
            column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("vector")
        )
        .filter(F.col("vec_id").isNotNull() & _sound(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )
    sound = written(sound.withColumn("dim", F.size("vector")), "vectors")
    common = sound.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    sound = sound.filter(F.col("dim") == common[0].dim).drop("dim")
    total = common[0]["count"]
    chance = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1_000_000)) / 1e6
    sample = sound.filter(chance < SAMPLE / total).select("vector").toArrow()
    if not sample.num_rows:
        sample = sound.limit(1).select("vector").toArrow()
    x, size = _unpacked(sample["vector"].to_pandas())
    codes = spark.sparkContext.broadcast(Codes(x / size[:, None], k))
    # Equal vectors: the smallest identifiers are all that can be among a query's k.
    folded = sound.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("held"))
    several = sound.join(folded.filter("held > 1").select("vector"), "vector")
    salted = several.select("vector", "vec_id", F.pmod("vec_id", F.lit(SALTS)).alias("salt")).withColumn(
        "place", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("vec_id"))
    )
    ids = (
        salted.filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    )
    distinct = written(
        folded.join(ids, "vector", "left").select("vector", F.coalesce("ids", F.array("least")).alias("ids"), "least"),
        "distinct",
    )
    asked = sound.filter(is_query)
    n_asked = asked.count()
    blocks, parts = -(-total // BLOCK), max(1, -(-n_asked // QUERIES))
    spot = F.pmod(F.xxhash64("least"), F.lit(blocks)).cast("int")
    rows = distinct.withColumn("block", spot).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = (
        asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumnRenamed("vec_id", "query_id")
    )
    found = (
        rows.select("block", "part", "vector", "ids")
        .groupBy("block", "part")
        .cogroup(queries.groupBy("block", "part"))
        .applyInPandas(_search(codes, k), "query_id long, vec_id long, score double")
    )
    order = F.struct((-F.col("score")).alias("far"), "vec_id")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "one")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.far")).alias("score")
    )

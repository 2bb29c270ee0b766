"""Similar vectors, threshold clusters, centroids, representatives and diverse selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrill.functions.vectors import cosine
from sparkrill.operators.components import components
from sparkrill.storage import written

BLOCK = 2048


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity), a < b, of the vectors (id, v) with at least that cosine. Exact: nothing is sampled or approximated.

    The set is cut into blocks by a hash; every pair of blocks is one matrix product in one task, so that a task holds
    2 * block vectors whatever the size of the set. Zero vectors are similar to none.
    """
    n = vectors.count()
    parts = max(1, -(-n // block))
    keyed = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    # A block meets each block once, itself included: pair (i, j) with i <= j.
    others = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    spread = keyed.withColumn("pair", F.explode(others)).select("id", "v", "part", "pair.i", "pair.j")

    def product(group: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(group["v"].to_numpy()).astype(np.float64)
        lengths = np.linalg.norm(values, axis=1, keepdims=True)
        values = np.divide(values, lengths, out=np.zeros_like(values), where=lengths > 0)
        ids, part = group["id"].to_numpy(), group["part"].to_numpy()
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        cos = values[left] @ values[right].T
        x, y = np.nonzero((cos >= threshold - 1e-12) & (ids[left][:, None] != ids[right][None, :]))
        a, b = ids[left][x], ids[right][y]
        keep = (a < b) if i == j else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": cos[x, y][keep]})

    return spread.groupBy("i", "j").applyInPandas(product, "a bigint, b bigint, similarity double")


def approximate_pairs(vectors: DataFrame, threshold: float, tables: int = 24, bits: int = 10, seed: int = 0) -> DataFrame:
    """(a, b, similarity), a < b: as similar_pairs, for high thresholds and sets too large for it. Vectors whose signs along `bits` random directions agree in one
    of `tables` draws are compared exactly; a pair at angle t is found with probability 1 - (1 - (1 - t / pi) ^ bits) ^ tables,
X

    Work grows with the vectors that share a code, not with all pairs; a larger set asks for more bits and tables. Zero vectors are similar to none.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.array(batch.column(1).to_pylist(), float)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((values.shape[1], tables * bits))
            signs = (values @ planes > 0).reshape(len(values), tables, bits)
            code = signs @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << bits)
            filled = np.linalg.norm(values, axis=1) > 0
            ids = np.repeat(batch.column(0).to_numpy()[filled], tables)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(code[filled].reshape(-1))], ["id", "code"])

    keyed = written(vectors.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(codes, "id bigint, code bigint"), "vector-codes")
    pairs = keyed.select(F.col("id").alias("a"), "code").join(keyed.select(F.col("id").alias("b"), "code"), "code").filter("a < b").select("a", "b").distinct()
    sides = pairs.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    return sides.select("a", "b", cosine(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def density_clusters(vectors: DataFrame, threshold: float, min_points: int = 3) -> DataFrame:
    """(id, cluster): vectors with at least min_points others that alike are dense; dense ones that are alike share a cluster, named by its smallest dense id;
    others belong to the most alike dense one (of equals the smaller id), or to -1, the noise."""
    pairs = written(similar_pairs(vectors, threshold), "density-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    dense = written(both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select(F.col("a").alias("id")), "density-points")
    inside = pairs.join(dense.select(F.col("id").alias("a")), "a", "left_semi").join(dense.select(F.col("id").alias("b")), "b", "left_semi")
    found = dense.join(components(inside.select("a", "b")).select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    edge = both.join(dense.select(F.col("id").alias("b")), "b", "left_semi").join(dense.select(F.col("id").alias("a")), "a", "left_anti")
    nearest = edge.groupBy("a").agg(F.max_by("b", F.struct(F.round("similarity", 9), -F.col("b"))).alias("b"))
    border = nearest.join(found.select(F.col("id").alias("b"), "cluster"), "b").select(F.col("a").alias("id"), "cluster")
    known = found.unionByName(border)
    return vectors.select("id").join(known, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def threshold_clusters(vectors: DataFrame, threshold: float, min_size: int = 2) -> DataFrame:
    """(id, cluster): single-link clusters at a cosine threshold; cluster is the smallest id. Smaller ones than min_size are left out."""
    found = components(written(similar_pairs(vectors, threshold).select("a", "b"), "vector-edges")).select("id", F.col("component").alias("cluster"))
    if min_size <= 1:
        alone = vectors.select("id").join(found, "id", "left_anti").select("id", F.col("id").alias("cluster"))
        found = found.unionByName(alone)
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return found.join(sizes.select("cluster"), "cluster", "left_semi").select("id", "cluster")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, centroid): the mean of each dimension; partial sums travel, not vectors."""
    cells = vectors.select(group, F.posexplode("v").alias("pos", "x"))
    means = cells.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("centroid"))


def representatives(vectors: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, n, id, similarity): the member nearest to each cluster's centroid, of equal ones the smallest id."""
    members = clustered.join(vectors, "id")
    near = members.join(centroids(members, "cluster"), "cluster").withColumn("similarity", cosine(F.col("v"), F.col("centroid")))
    return near.groupBy("cluster").agg(F.first("n").alias("n"), F.max_by("id", F.struct(F.round("similarity", 9), -F.col("id"))).alias("id"), F.max("similarity").alias("similarity"))


def mmr(vectors: DataFrame, group: str, k: int, weight: float = 0.7) -> DataFrame:
    """(group, place, id): k members of each group by maximal marginal relevance to its centroid, of equal ones the smallest id.

    Each step scores all members by relevance less the highest similarity to those chosen: k aggregations over the
    distributed rows, so that a group of any size stays spread out.
    """
    rows = written(vectors.join(centroids(vectors, group).select(group, "centroid"), group).withColumn("relevance", cosine(F.col("v"), F.col("centroid"))).drop("centroid").withColumn("closest", F.lit(0.0)), "mmr-rows")
    chosen: list[DataFrame] = []
    for place in range(1, k + 1):
        score = F.round(weight * F.col("relevance") - (1 - weight) * F.col("closest"), 9) if place > 1 else F.round("relevance", 9)
        best = rows.groupBy(group).agg(F.max_by(F.struct("id", "v"), F.struct(score, -F.col("id"))).alias("best")).select(group, F.col("best.id").alias("chosen"), F.col("best.v").alias("w"))
        best = written(best, "mmr-best")
        chosen.append(best.select(group, F.lit(place).alias("place"), F.col("chosen").alias("id")))
        near = cosine(F.col("v"), F.col("w"))
        closest = F.greatest("closest", near) if place > 1 else near
        rows = written(rows.join(best, group).filter("id <> chosen").withColumn("closest", closest).drop("chosen", "w"), "mmr-rows")
    result = chosen[0]
    for more in chosen[1:]:
        result = result.unionByName(more)
    return result


def hashed_bag(texts: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """texts with v: a unit vector of word counts hashed by md5, a stand-in for an embedding model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import re

        for batch in batches:
            vectors = []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                v = np.zeros(dims)
                for word in re.findall(r"\w+", (value or "").lower()):
                    v[int.from_bytes(hashlib.md5(word.encode()).digest()[-4:], "big") % dims] += 1
                length = np.linalg.norm(v)
                vectors.append((v / length if length else v).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, "v"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("v", ArrayType(DoubleType()))]))

"""Clustering of texts by topic: TF-IDF, hashed vectors, k-means per document."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut

#: Dimensions of a hashed text vector.
DIMENSIONS = 32
#: Points of a group that one call of Python holds.
PART = 4096
#: Largest number of clusters tried, rounds of k-means, and starts for each number.
MAX_K, ROUNDS, STARTS = 10, 5, 3


def cluster_text(paths: Column, tags: Column) -> Column:
    """What represents a chunk: its paths joined by semicolons, a double bar, its tags joined by spaces."""
    empty = F.array().cast("array<string>")
    return F.concat(F.array_join(F.coalesce(paths, empty), " ; "), F.lit(" || "), F.array_join(F.coalesce(tags, empty), " "))


def terms(frame: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Term counts of each text: lower case, words of two or more characters."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term")
    return frame.select(*keys, words).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(frame: DataFrame, keys: list[str], text: str, within: list[str] | None = None) -> DataFrame:
    """``keys, term, weight``: tf times ln((1+n)/(1+df))+1, scaled to length 1.

    ``within`` names the columns of a corpus (none: one corpus).  Texts without
    a term yield no row but count in n.
    """
    within = within or []
    counted = terms(frame, keys, text)
    df = counted.groupBy(*within, "term").agg(F.count(F.lit(1)).alias("df"))
    total = frame.groupBy(*within).agg(F.count(F.lit(1)).alias("n"))
    weighed = counted.join(df, [*within, "term"])
    # Without ``within`` the total is one row.
    weighed = weighed.join(total, within) if within else weighed.withColumn("n", F.lit(frame.count()))
    raw = weighed.withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    # A window over one text, as large as its different words, in place of a second aggregate and join.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def hashed_vectors(weights: DataFrame, keys: list[str], dimensions: int = DIMENSIONS) -> DataFrame:
    """Signed feature hashing of weighted terms into a dense array ``v``."""
    h = F.xxhash64("term")
    signed = weights.select(*keys, F.pmod(h, F.lit(dimensions)).alias("_d"), F.when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, F.col("weight")).otherwise(-F.col("weight")).alias("_w"))
    sums = [F.sum(F.when(F.col("_d") == i, F.col("_w")).otherwise(0.0)) for i in range(dimensions)]
    return signed.groupBy(*keys).agg(F.array(*sums).alias("v"))


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(points: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "v") -> DataFrame:
    """Adds ``cluster`` and ``distance`` of the nearest centroid; ties go to the first.  The centroids are part of the expression."""
    if len(centroids) > 1000:
        raise ValueError("more than 1000 centroids do not fit an expression")
    each = [F.struct(_distance2(F.col(vector), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in centroids]
    best = F.array_min(F.array(*each))
    return points.withColumn("_b", best).withColumn("cluster", F.col("_b.i")).withColumn("distance", F.sqrt("_b.d")).drop("_b")


def centroids_of(points: DataFrame, label: str, vector: str, dimensions: int) -> DataFrame:
    """Mean vector per label: one aggregate with one mean per dimension."""
    return points.groupBy(label).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"c{i}") for i in range(dimensions)])


def grouped_kmeans(points: DataFrame, group: str, key: str, vector: str = "v", dimensions: int = DIMENSIONS, max_k: int = MAX_K, rounds: int = ROUNDS, starts: int = STARTS) -> DataFrame:
    """Clusters within every group at once: ``group, key, cluster, k``.

    For each k from 2 to min(max_k, n-1) the points of a group start from k
    points of smallest hash, several times with other hashes, and move for some
    rounds; of the starts that with the least sum of squares is kept.  The k
    with the largest mean silhouette (distances to the centroids) wins, ties go
    to the smallest k.  A group of one point, or of points that are all alike,
    is one cluster; a group of two is two.

    Points lie in parts of a group, so a group may hold any share of all
    points; a part meets the centroids of its group once, for all k and starts,
    and yields sums per cluster, which are added up by group.
    """
    base = cut(points.select(group, key, vector))
    spread = base.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.greatest(*[F.coalesce(F.stddev_pop(F.col(vector)[i]), F.lit(0.0)) for i in range(dimensions)]).alias("_s"))
    spread = cut(spread.withColumn("_use", (F.col("_n") >= 2) & (F.col("_s") > 1e-12)))
    usable = spread.where("_use").select(group, F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(max_k), (F.col("_n") - 1).cast("int"))))).alias("k"))
    parted = cut(base.join(spread.where("_use").select(group, F.ceil(F.col("_n") / PART).alias("_parts")), group).select(group, F.pmod(F.xxhash64(key), F.col("_parts")).alias("_part"), key, vector))
    parts = cut(parted.select(group, "_part").distinct())
    # The k points of smallest hash per start: a ranked window that Spark limits before it shuffles.
    hashed = parted.select(group, key, vector, F.explode(F.array(*map(F.lit, range(starts)))).alias("_start"))
    first = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_start").orderBy(F.xxhash64(key, "_start"), key))).where(F.col("_r") <= max_k)
    seeds = first.groupBy(group, "_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", vector))), lambda x: x[vector]).alias("_all"))
    case = [group, "k", "_start"]
    centres = cut(usable.join(seeds, group).select(*case, F.slice("_all", 1, F.col("k")).alias("c")))
    kind, key_kind = (base.schema[c].dataType.simpleString() for c in (group, key))

    def met(c: DataFrame, make: Callable, schema: str) -> DataFrame:
        """``make`` of every part of a group and the group's centroids."""
        near = c.join(parts, group).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "k", "_start", "c")
        return parted.groupBy(group, "_part").cogroup(near.groupBy("_g", "_p")).applyInPandas(make, f"`{group}` {kind}, {schema}")

    def summed(_: tuple, own: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        x = _matrix(own[vector], dimensions)
        for g, k, start, centroids in zip(c["_g"], c["k"], c["_start"], c["c"]):
            d = _distances(x, _matrix(centroids, dimensions))
            cluster, near = d.argmin(axis=1), np.sqrt(np.sort(d, axis=1)[:, :2])
            silhouette = np.divide(near[:, 1] - near[:, 0], near[:, 1], out=np.zeros(len(x)), where=near[:, 1] > 0)
            for i in np.unique(cluster):
                mine = cluster == i
                rows.append((g, int(k), int(start), int(i), int(mine.sum()), x[mine].sum(axis=0).tolist(), float(d[mine, i].sum()), float(silhouette[mine].sum())))
        return pd.DataFrame(rows, columns=[*case, "cluster", "n", "s", "e", "q"])

    def sums(c: DataFrame) -> DataFrame:
        """Size, mean, sum of squares and of silhouettes of every cluster of every case."""
        partial = met(c, summed, "k int, _start int, cluster int, n long, s array<double>, e double, q double")
        n = F.sum("n")
        return partial.groupBy(*case, "cluster").agg(n.alias("n"), F.array(*[F.sum(F.col("s")[i]) / n for i in range(dimensions)]).alias("m"), F.sum("e").alias("e"), F.sum("q").alias("q"))

    for _ in range(rounds):
        moved = sums(centres).groupBy(*case).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "m"))).alias("_m"))
        # An empty cluster keeps its centre.
        centres = cut(centres.join(moved, case).select(*case, F.transform("c", lambda x, i: F.coalesce(F.element_at("_m", i), x)).alias("c")))
    # A cluster of one point counts as 0, as in the usual definition.
    scored = sums(centres).groupBy(*case).agg(F.sum("e").alias("_e"), (F.sum(F.when(F.col("n") > 1, F.col("q")).otherwise(0.0)) / F.sum("n")).alias("_q"))
    least = scored.groupBy(group, "k").agg(F.min_by(F.struct("_start", "_q"), F.struct(F.round("_e", 9), "_start")).alias("_b")).select(group, "k", "_b._start", "_b._q")
    best = least.groupBy(group).agg(F.max_by(F.struct("k", "_start"), F.struct(F.round("_q", 9), -F.col("k"))).alias("_b")).select(group, "_b.k", "_b._start")

    def labelled(_: tuple, own: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(own[vector], dimensions)
        found = _distances(x, _matrix(c["c"].iloc[0], dimensions)).argmin(axis=1) if len(c) else np.zeros(len(x))
        return pd.DataFrame({group: own[group], key: own[key], "cluster": found.astype("int32"), "k": int(c["k"].iloc[0]) if len(c) else 1})

    chosen = met(centres.join(best, case, "left_semi"), labelled, f"`{key}` {key_kind}, cluster int, k int")
    single = base.join(spread.where("not _use").select(group), group, "left_semi").select(group, key, F.lit(0).alias("cluster"), F.lit(1).alias("k"))
    return chosen.unionByName(single)


def _matrix(rows: Iterable, dimensions: int) -> np.ndarray:
    return np.array([np.asarray(r, dtype=float) for r in rows]).reshape(-1, dimensions)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each centroid."""
    return ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)


def truncated_svd(points: DataFrame, vector: str, dimensions: int, rank: int = 50) -> list[list[float]]:
    """Right singular vectors of the matrix of all points, largest first, at most ``rank``.

    The Gram matrix (dimensions squared) is summed by Spark; nothing grows with
    the number of points.
    """
    def partial(batches):  # one Gram matrix per task
        import pyarrow as pa

        gram = np.zeros((dimensions, dimensions))
        for batch in batches:
            rows = [v for v in batch.column(0).to_pylist() if v is not None]
            if rows:
                x = np.asarray(rows, dtype=float)
                gram += x.T @ x
        i, j = np.triu_indices(dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(gram[i, j])], names=["i", "j", "g"])

    gram = np.zeros((dimensions, dimensions))
    for r in points.select(vector).mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["g"]
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:rank]
    return [list(map(float, vectors[:, i] * (1 if vectors[np.argmax(np.abs(vectors[:, i])), i] > 0 else -1))) for i in order if values[i] > 1e-12]


def project(points: DataFrame, basis: list[list[float]], vector: str = "v", out: str = "p") -> DataFrame:
    """Coordinates of each point along ``basis``."""
    along = [F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(x) for x in b]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for b in basis]
    return points.withColumn(out, F.array(*along) if along else F.array().cast("array<double>"))

"""Ball k-means: exact k-means over integer vectors that compares members with the centroids near their ball only."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from barloom.llm.shared import drop_table, materialize, read

#: Larger components count as this, so that squared distances of 64 components stay within a long.
MOST = 2**27
#: Every task holds all centroids and the order of each one's neighbours, so their number is bounded.
MOST_CLUSTERS = 5_000


def whole_vectors(table: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``_key, components``: the vectors of ``dims`` finite components, each as floor(scale * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # floor is taken of a clamped double, as a long can't hold every one
    whole = F.transform(vector, lambda x: F.floor(F.least(F.lit(float(MOST)), F.greatest(F.lit(-float(MOST)), F.lit(float(scale)) * x.cast("double")))).cast("int"))
    return table.filter((F.size(vector) == dims) & finite).select(F.col(key).alias("_key"), whole.alias("components"))


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = rows - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """Centroids, and for each ball the other centroids that can be nearer to one of its members, nearest first.

    A member at distance d of its centroid can only be as near to another if that lies within 2 d of the centroid, so a ball of
    radius r has the centroids within 2 r as neighbours. Without radii all are.
    """

    def __init__(self, centroids: np.ndarray, radii: list[int] | None = None):
        self.centroids = centroids
        self.order, self.gaps = [], []
        for i, c in enumerate(centroids):
            gap = squared(centroids, c)
            near = np.delete(np.argsort(gap, kind="stable"), np.flatnonzero(np.argsort(gap, kind="stable") == i))
            if radii is not None:
                near = near[gap[near] <= min(4 * radii[i] ** 2, 2**63 - 1)]
            self.order.append(near)
            self.gaps.append(gap[near])

    def assign(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each row, the smaller number of ties, its squared distance, and how many distances were taken.

        ``own`` is a row's ball. Rows within half of the way to the first neighbour are its stable core and stay. The others lie in
        annuli between the halves of the ways to one neighbour and the next, and are compared with those up to theirs.
        """
        best, distance, taken = own.copy(), np.zeros(len(rows), np.int64), len(rows)
        for ball in np.unique(own).tolist():
            members = np.flatnonzero(own == ball)
            mine = squared(rows[members], self.centroids[ball])
            annulus = np.searchsorted(self.gaps[ball], 4 * mine, "right")
            number = np.full(len(members), ball)
            nearest = mine.copy()
            for k in range(int(annulus.max(initial=0))):
                out = np.flatnonzero(annulus > k)
                other = int(self.order[ball][k])
                gap = squared(rows[members[out]], self.centroids[other])
                won = out[(gap < nearest[out]) | ((gap == nearest[out]) & (other < number[out]))]
                nearest[out] = np.minimum(nearest[out], gap)
                number[won] = other
                taken += len(out)
            best[members], distance[members] = number, nearest
        return best, distance, taken


def assigned(state: DataFrame, balls: Balls, name: str) -> DataFrame:
    """A table of ``state``'s members in their new clusters and, from each task, a row of sums for each cluster.

    Members have ``_key, components, cluster, distance``; rows of sums have ``size, sums, radius, inertia, taken`` instead, so
    one pass over the vectors does a round and the next centroids come from narrow columns.
    """
    k, dims = balls.centroids.shape
    key = state.schema["_key"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size, radius, inertia, taken = np.zeros((k, dims), np.int64), *(np.zeros(k, np.int64) for _ in range(4))
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten()).astype(np.int64).reshape(-1, dims)
            own = np.asarray(batch.column(2)).astype(np.int64)
            cluster, distance, n = balls.assign(rows, own)
            order = np.argsort(cluster, kind="stable")
            found, at = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(rows[order], at)
            size += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, distance)
            np.add.at(inertia, cluster, distance)
            taken[0] += n
            nothing = [pa.nulls(len(rows), t) for t in types[4:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cluster.astype(np.int32)), pa.array(distance), *nothing], names)
        some = np.flatnonzero((size > 0) | (taken > 0))
        if len(some):
            own_sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(sums[some].ravel()))
            none = [pa.nulls(len(some), key_type[0]), pa.nulls(len(some), types[1])]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.array(size[some]), own_sums, *(pa.array(x[some]) for x in (radius, inertia, taken))], names)

    names = ["_key", "components", "cluster", "distance", "size", "sums", "radius", "inertia", "taken"]
    types = [None, pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
    key_type = [_arrow(key.dataType)]
    long = lambda c: StructField(c, LongType())
    schema = StructType([key, StructField("components", ArrayType(IntegerType())), StructField("cluster", IntegerType()), long("distance"), long("size"), StructField("sums", ArrayType(LongType())), long("radius"), long("inertia"), long("taken")])
    return materialize(state.select("_key", "components", "cluster").mapInArrow(work, schema), name)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def totals(state: DataFrame, dims: int) -> dict[int, dict]:
    """Of each cluster: its size, sums of components, largest squared distance and sum of them; from the tasks' rows, a few for each cluster."""
    rows = state.filter("size is not null").groupBy("cluster")
    found = rows.agg(F.sum("size").alias("size"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"), F.sum("taken").alias("taken"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    return {r["cluster"]: r.asDict() for r in found.collect()}


def ball_kmeans(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Members (``_key, components, cluster, distance``) and clusters (``cluster, size, inertia, centroid, taken``).

    Vectors that are null, of another length, or hold a null or a component that isn't finite take no part; components
    beyond ``MOST`` count as it. Centroids start as the ``k`` vectors of the smallest SHA-256 of ``seed:key``, null keys last, ties
    by components. A round assigns all vectors and moves each centroid to the floor of its members' means; without members
    it stays. Repeated rows are vectors of their own. Of fewer vectors than ``k`` each is a centroid; no vectors give no
    rows. Other columns aren't looked at, whatever their names.

    Radii go from a round to the next: members were within the old radius of the old centroid, so they are within that plus its
    move of the new one. A round reads the vectors once and writes them with their clusters, so a lost executor
    costs its tasks only; the table before is deleted. What comes to the driver is a row for each cluster.
    """
    if k > MOST_CLUSTERS:
        raise ValueError(f"at most {MOST_CLUSTERS} clusters")
    spark = table.sparkSession
    vectors = materialize(whole_vectors(table, key, vector, dims, scale), "vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256)
    seeds = [r["components"] for r in vectors.orderBy(place.asc_nulls_last(), "components").limit(k).select("components").collect()]
    clusters = "cluster int, size long, inertia long, centroid array<long>, taken long"
    if not seeds:
        none = StructType([StructField("cluster", IntegerType()), StructField("distance", LongType())])
        return vectors.withColumns({f.name: F.lit(None).cast(f.dataType) for f in none}), spark.createDataFrame([], clusters)
    centroids, radii = np.array(seeds, np.int64), None
    state, taken = vectors.withColumn("cluster", F.lit(0)), 0
    for step in range(rounds + 1):
        after = assigned(state, Balls(centroids, radii), "members")
        drop_table(state)
        state, found = after.filter("size is null"), totals(after, dims)
        taken += sum(t["taken"] for t in found.values())
        if step < rounds:
            moved = centroids.copy()
            radii = [0] * len(centroids)
            for c, t in found.items():
                if t["size"]:
                    moved[c] = [s // t["size"] for s in t["sums"]]
                    move = moved[c] - centroids[c]
                    radii[c] = math.isqrt(t["radius"]) + math.isqrt(int(move @ move)) + 2
            centroids = moved
    none = {"size": 0, "inertia": 0}
    rows = [(c, found.get(c, none)["size"], found.get(c, none)["inertia"], centroids[c].tolist(), taken) for c in range(len(centroids))]
    return state.select("_key", "components", "cluster", "distance"), spark.createDataFrame(rows, clusters)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, clusters = ball_kmeans(read(spark, sf_dir, "embeddings"))
    of = clusters.collect()  # a row for each of at most 40 clusters
    rows = [(r["cluster"], r["inertia"], sum(x["inertia"] for x in of), hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in of]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(named, "cluster").select(F.col("_key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})"""
    ]
    for t in range(rounds + 1):
        steps.append(f"""d{t} AS (SELECT vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{t}),
a{t} AS (SELECT * FROM d{t} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if t < rounds:
            steps.append(f"""u{t} AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}),
s{t} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{t} GROUP BY k, i),
m{t} AS (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY k),
c{t + 1} AS (SELECT c{t}.k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE = _oracle()

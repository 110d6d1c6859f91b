"""Clustering of integer vectors around centroids, with a filter on rotated coordinates.

A vector of `size` components, none null or not finite, becomes the integers floor(scale * x). The integer
vectors are stored once with their leading coordinates after a rotation (principal components) and the norm of
what those coordinates leave out. For a centroid in the same form, the squared distance of the leading
coordinates plus the squared difference of the norms is at most the squared distance of the vectors. Each
round, the exact distance to the centroid of least bound is found in integers; only centroids whose bound is
within it are looked at further, in integers as well. Rounding of the bounds is allowed for by a margin of
`SLACK` of the squared norms, some thousand times what floats lose, so results are those of integers alone.

A round is one pass over the stored table: tasks add up their vectors for each centroid, and Spark adds these
sums for each centroid and component. The driver holds the centroids and the rotation: numbers that depend on
`k` and `size`, not on the rows. A round that leaves all centroids where they are is the last that is computed,
since later ones would repeat it.

Defined results: vectors of another length, with nulls or with components that aren't finite are left out. Components
saturate at 2^27 either way, so that squared distances fit a long; sums beyond a long saturate. Fewer kept
vectors than k make as many centroids; none make an empty table. A null vec_id hashes as an empty one and stays null;
vectors of one vec_id are ordered by their components among the starting centroids, so repeated rows start centroids of their own, of which all
but the first stay as they are. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import staged

#: Components saturate here.
MOST = 1 << 27
#: Part of the squared norms that the bounds may be too large by.
SLACK = 1e-9
#: Rows that a task takes at a time.
ROWS = 4096
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of long."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))))
    return vectors.select("vec_id", x.alias("x")).where((F.size("x") == size) & finite).select("vec_id", scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def rotation(vectors: DataFrame, size: int, leading: int) -> np.ndarray:
    """Orthonormal leading directions of all vectors: of the matrix of their products, which tasks add up."""

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            for x in parts(b, size):
                f = x.astype(np.float64)
                total += f.T @ f
        yield pa.RecordBatch.from_pydict({"at": np.arange(size * size, dtype=np.int32), "part": total.ravel()})

    rows = vectors.select("v").mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    products = np.zeros(size * size)
    for r in rows:
        products[r["at"]] = r["part"]
    return np.linalg.eigh(products.reshape(size, size))[1][:, ::-1][:, :leading].copy()


def parts(batch: pa.RecordBatch, size: int, column: str = "v"):
    """The arrays of a list column in matrices of at most ROWS rows."""
    values = batch.column(batch.schema.get_field_index(column))
    for k in range(0, len(values), ROWS):
        yield np.asarray(values.slice(k, ROWS).flatten()).reshape(-1, size)


def project(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading coordinates, norm of the rest, squared norm."""
    f = x.astype(np.float64)
    lead = f @ turn
    rest = f - lead @ turn.T
    return lead, np.sqrt((rest * rest).sum(1)), (f * f).sum(1)


def stored(vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    """The vectors with their leading coordinates, rest and squared norm, written once."""
    size = len(turn)

    def run(batches):
        for b in batches:
            for k, x in zip(range(0, b.num_rows, ROWS), parts(b, size), strict=False):
                lead, rest, norm = project(x, turn)
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * lead.shape[1], pa.array(lead.ravel()))
                rows = b.slice(k, len(x))
                yield pa.RecordBatch.from_arrays([*rows.columns, flat, pa.array(rest), pa.array(norm)], names=["vec_id", "v", "lead", "rest", "norm"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return staged(vectors.mapInArrow(run, f"vec_id {kind}, v array<long>, lead array<double>, rest double, norm double"))


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, norm: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the smaller number among equals."""
    c_lead, c_rest, c_norm = project(centroids, turn)
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    bound -= SLACK * (norm[:, None] + c_norm[None] + 1)
    best = bound.argmin(1)
    distance = exact(x, centroids[best])
    for j in range(len(centroids)):
        left = np.flatnonzero((best != j) & (bound[:, j] <= distance))
        if len(left):
            d = exact(x[left], centroids[j])
            better = (d < distance[left]) | ((d == distance[left]) & (j < best[left]))
            best[left[better]], distance[left[better]] = j, d[better]
    return best, distance


def assigned(batches, centroids: np.ndarray, turn: np.ndarray):
    """(rows, matrix, number, distance) of the parts of stored batches."""
    for b in batches:
        column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for k, x, lead in zip(range(0, b.num_rows, ROWS), parts(b, len(turn)), parts(b, turn.shape[1], "lead"), strict=False):
            rest, norm = (column[n].slice(k, ROWS).to_numpy() for n in ("rest", "norm"))
            yield (b.slice(k, len(x)), x, *nearest(x, lead, rest, norm, centroids, turn))


def moved(table: DataFrame, centroids: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The centroids of the next round: floors of the exact means."""
    k, size = centroids.shape

    def run(batches):
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, x, best, _ in assigned(batches, centroids, turn):
            for j in range(k):
                own = x[best == j]
                count[j] += len(own)
                total[j] += own.sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(k * size, dtype=np.int32), "part": total.ravel(), "n": np.repeat(count, size)})

    rows = table.select("v", "lead", "rest", "norm").mapInArrow(run, "at int, part long, n long")
    out = centroids.copy().ravel()
    for r in rows.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("n").alias("n")).collect():
        if r["n"]:
            out[r["at"]] = int(r["part"]) // r["n"]
    return out.reshape(k, size)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024, leading: int = 12) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector, as a written table, and the final centroids."""
    kept = integers(vectors, size, scale)
    centroids = first_centroids(kept, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    form = f"vec_id {kind}, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], form), centroids
    turn = rotation(kept, size, leading)
    table = stored(kept, turn)
    for _ in range(rounds):
        last, centroids = centroids, moved(table, centroids, turn)
        if (last == centroids).all():
            break

    def run(batches):
        for rows, _, best, distance in assigned(batches, centroids, turn):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return staged(table.mapInArrow(run, form)), centroids


def report(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(vectors, **how)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), LONG)
    # one row for each centroid
    known = [(j, min(s, LONG), whole, digest(centroids[j])) for j, s in sums.items()]
    each = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> str:
    """The definition in DuckDB SQL, round by round, without bounds."""
    steps = [
        f"x as materialized (select vec_id, list_transform(embedding, lambda c: floor({scale} * c::double)::bigint) as v from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = {size})",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as j, v as c from x qualify row_number() over (order by sha256('{seed}:' || vec_id), v) <= {k})",
    ]
    distance = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    near = "select vec_id, v, arg_min(j, (d, j)) as j, min(d) as d from (select vec_id, v, j, {0} as d from x, c{1}) group by 1, 2"
    for r in range(rounds):
        steps += [
            f"a{r} as materialized ({near.format(distance, r)})",
            f"m{r} as materialized (select j, list(m order by i) as m from (select j, i, (s - ((s % n) + n) % n) // n as m from (select j, i, sum(v[i]) as s, count(*) as n from a{r}, range(1, {size + 1}) t(i) group by 1, 2)) group by 1)",
            f"c{r + 1} as materialized (select j, coalesce(m, c)::bigint[] as c from c{r} left join m{r} using (j))",
        ]
    return (
        f"with {', '.join(steps)}, f as ({near.format(distance, rounds)}) select vec_id, j::int as cluster, d as distance, (sum(d) over (partition by j))::bigint as cluster_inertia, "
        f"(sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from f join c{rounds} using (j)"
    )

"""K-means over integer vectors with Hamerly's bounds.

Vectors become integers once and wait in blocks of the shared folder. What a round carries on is a row for each
block: the cluster of each of its vectors, an upper bound of the distance to its centroid and a lower bound
of the distance to the second-nearest one. When centroids have moved, the bounds are loosened by their drift; a
vector whose upper bound stays below its lower bound, or below half the way to the next centroid, keeps its
cluster without being looked at. The others get an exact distance, and, where that isn't enough, an exact scan
of all centroids in integers. Bounds are floats with a margin above their rounding, so they only ever cause
a scan too many; a tie is never within them, and a scan gives it to the smaller number.

Sums of clusters change by the vectors that move, so blocks in which nothing is ambiguous aren't opened. The
driver holds the centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove_folder, shared_dir, written

SCALE = 1_024
#: Components lie within 2**27 either way: then a squared distance of 64 of them fits a long.
MOST = 2**27
BLOCK_ROWS = 65_536
TASK_BITS = 15
#: Relative margin of a bound, far above the rounding of a double.
MARGIN = 1e-12
#: A lower bound where there is no second centroid.
NEVER = 1e300

STATE = "block long, rows long, cluster binary, upper binary, lower binary, scanned long, moved array<struct<cluster: int, n: long, sums: array<long>>>"


def kept_vectors(vectors: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v: integers floor(1024 * x) of the vectors with so many components, all of them finite."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    far = F.exists(x, lambda c: F.abs(c) >= MOST / SCALE)
    whole = F.transform(x, lambda c: F.floor(c * SCALE).cast("int"))
    checked = F.when(far, F.raise_error(F.lit(f"components must lie within {MOST // SCALE} either way"))).otherwise(whole)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), checked.alias("v"))


def _stored(folder: str, size: int):
    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        held, rows, count = [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal held, rows, count
            name, n = TaskContext.get().taskAttemptId() << TASK_BITS | count, rows
            table = pa.Table.from_batches(held)
            with fs.open_output_stream(f"{root}/{name}.block") as sink, pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table)
            held, rows, count = [], 0, count + 1
            return pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "rows": pa.array([n], pa.int64())})

        for batch in batches:
            flat = batch.column("v").flatten()
            held.append(pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.FixedSizeListArray.from_arrays(flat, size)], names=["vec_id", "v"]))
            rows += len(batch)
            if rows >= BLOCK_ROWS:
                yield block()
        if rows:
            yield block()

    return stored


def _opened(folder: str, name: int, size: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a block."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}.block") as source:
        table = pa.ipc.open_file(source).read_all().combine_chunks()
    v = table.column("v").combine_chunks()
    v = v if isinstance(v, pa.Array) else v.chunk(0)
    return table.column("vec_id"), v.flatten().to_numpy().reshape(-1, size)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, in integers. A piece of rows at a time."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for i in range(0, len(vectors), 4_096):
        part = vectors[i : i + 4_096].astype(np.int64)
        for j, c in enumerate(centroids):
            d = part - c
            out[i : i + 4_096, j] = np.einsum("ij,ij->i", d, d)
    return out


def assigned(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, open_block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Clusters and bounds under new centroids, the rows that were scanned, and the vectors if they were read.

    open_block gives the vectors; it is called only if a row is ambiguous.
    """
    drift = np.sqrt(((old - new).astype(np.float64) ** 2).sum(1)) * (1 + MARGIN)
    far = np.sqrt(distances(new, new).astype(np.float64))
    np.fill_diagonal(far, np.inf)
    half = far.min(1) / 2 * (1 - MARGIN)
    away = np.array([np.delete(drift, k).max(initial=0.0) for k in range(len(new))])  # of the other centroids
    upper, lower = (upper + drift[cluster]) * (1 + MARGIN), (lower - away[cluster]) - np.abs(lower) * MARGIN
    unsure = np.flatnonzero(~(upper < np.maximum(lower, half[cluster])))
    if not len(unsure):
        return cluster, upper, lower, unsure, None
    vectors, cluster = open_block(), cluster.copy()
    d = vectors[unsure].astype(np.int64) - new[cluster[unsure]]
    upper[unsure] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * (1 + MARGIN)
    scan = unsure[~(upper[unsure] < np.maximum(lower[unsure], half[cluster[unsure]]))]
    found = distances(vectors[scan], new)
    cluster[scan] = found.argmin(1)  # of equal ones the first
    near = np.sort(found, 1).astype(np.float64)
    upper[scan] = np.sqrt(near[:, 0]) * (1 + MARGIN)
    lower[scan] = np.sqrt(near[:, 1]) * (1 - MARGIN) if len(new) > 1 else NEVER
    return cluster, upper, lower, scan, vectors


def _round(folder: str, size: int, old: list[list[int]] | None, new: list[list[int]]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = np.array(new, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                read = lambda: _opened(folder, r["block"], size)[1]  # noqa: B023, E731
                if old is None:  # nothing is known yet: all rows are ambiguous
                    before = np.full(r["rows"], -1)
                    known = np.zeros(r["rows"], np.int64), np.full(r["rows"], np.inf), np.zeros(r["rows"])
                else:
                    known = np.frombuffer(r["cluster"], np.uint16).astype(np.int64), np.frombuffer(r["upper"]), np.frombuffer(r["lower"])
                    before = known[0]
                cluster, upper, lower, scan, vectors = assigned(*known, now if old is None else np.array(old, np.int64), now, read)
                changed, moved = np.flatnonzero(cluster != before), []
                for k in range(len(new)):
                    come, gone = changed[cluster[changed] == k], changed[before[changed] == k]
                    if len(come) or len(gone):
                        sums = vectors[come].sum(0, dtype=np.int64) - vectors[gone].sum(0, dtype=np.int64)
                        moved.append({"cluster": k, "n": len(come) - len(gone), "sums": sums.tolist()})
                state = {"block": r["block"], "rows": r["rows"], "cluster": cluster.astype(np.uint16).tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "scanned": len(scan), "moved": moved}
                yield pa.RecordBatch.from_pylist([state], schema=STATE_ARROW)

    return step


STATE_ARROW = pa.schema(
    [("block", pa.int64()), ("rows", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scanned", pa.int64())]
    + [("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))]
)


def _final(folder: str, size: int, centroids: list[list[int]]):
    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = np.array(centroids, np.int64)
        for batch in batches:
            for name, held in zip(batch.column("block").to_pylist(), batch.column("cluster").to_pylist()):
                ids, vectors = _opened(folder, name, size)
                cluster = np.frombuffer(held, np.uint16).astype(np.int64)
                for i in range(0, len(cluster), 8_192):
                    own = cluster[i : i + 8_192]
                    d = vectors[i : i + 8_192].astype(np.int64) - now[own]
                    part = ids.slice(i, 8_192).combine_chunks()
                    yield pa.RecordBatch.from_arrays([part if isinstance(part, pa.Array) else part.chunk(0), pa.array(own.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

    return final


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k ids with the smallest hash; equal ids in the order of their vectors. Rows without an id can't be one."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in kept.where(F.col("vec_id").isNotNull()).withColumn("h", named).orderBy("h", "v").limit(k).select("v").collect()]


def _kept(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Vectors that are null, of another size, or with a null or non-finite component don't come back; of fewer than k
    kept vectors each starts a centroid. Equal rows are rows each; a null id comes back as null. An empty table, or
    one without ids, gives no rows; other columns are not read. A component of 2**17 or more raises an error, as
    squared distances wouldn't fit a long.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    kept = kept_vectors(vectors, size, id_col, vector_col)
    centers, before, folder = first_centroids(kept, k, seed), None, new_path(spark, "vectors")
    if not centers:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    path, state = _kept(kept.mapInArrow(_stored(folder, size), "block long, rows long"), "vector-blocks")
    totals = [(0, [0] * size) for _ in centers]
    for r in range(rounds + 1):
        past = path
        path, state = _kept(state.mapInArrow(_round(folder, size, before, centers), STATE), "bounds")
        remove_folder(past)
        if r == rounds:
            break
        m = state.select(F.explode("moved").alias("m"))
        sums = m.groupBy("m.cluster").agg(F.sum("m.n").alias("n"), *(F.sum(F.col("m.sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)))
        for row in sums.collect():  # a row for each centroid
            n, s = totals[row["cluster"]]
            totals[row["cluster"]] = n + row["n"], [a + int(row[f"s{i}"]) for i, a in enumerate(s)]
        before, centers = centers, [[a // n for a in s] if n else c for c, (n, s) in zip(centers, totals)]
    told = written(state.select("block", "cluster").mapInArrow(_final(folder, size, centers), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {row["cluster"]: int(row["s"]) for row in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    of = lambda values: _by_cluster(values, len(centers))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return told.select("*", of([inertia.get(c, 0) for c in range(len(centers))]).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"))


def _by_cluster(values: list, n: int) -> Column:
    """A value for each cluster: they are as few as centroids."""
    kind = "string" if isinstance(values[0], str) else "long"
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

"""Point clouds, meshes, shape description and the point encoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import NAN


def centred(points: DataFrame, by: str = "axis") -> DataFrame:
    """Clouds moved to their mean and scaled by the largest coordinate ('axis') or norm ('norm'), if it isn't 0."""
    w = W.partitionBy("cloud_id")
    points = points.withColumns({c: F.col(c) - F.avg(c).over(w) for c in "xyz"})
    size = F.greatest(*(F.abs(F.col(c)) for c in "xyz")) if by == "axis" else F.sqrt(sum(F.col(c) * F.col(c) for c in "xyz"))
    points = points.withColumn("__s", F.max(size).over(w))
    return points.withColumns({c: F.when(F.col("__s") > 0, F.col(c) / F.col("__s")).otherwise(F.col(c)) for c in "xyz"}).drop("__s")


def voxels(points: DataFrame, size: float = 0.01) -> DataFrame:
    """The centroid of each occupied cell; cells are counted from the cloud's smallest corner."""
    low = points.groupBy("cloud_id").agg(*(F.min(c).alias(f"lo_{c}") for c in "xyz"))
    cell = [F.floor((F.col(c) - F.col(f"lo_{c}")) / size).alias(f"cell_{c}") for c in "xyz"]
    return points.join(low, "cloud_id").groupBy("cloud_id", *cell).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))


def alpha_candidates(nn: Column, diagonal: Column) -> Column:
    """Ascending distinct radii to try: multiples of the neighbour distance, at least .05, and shares of the diagonal."""
    near = F.array(*(F.greatest(nn * s, F.lit(0.05)) for s in (3.0, 6.0, 12.0, 24.0, 30.0)))
    far = F.array(*(diagonal * s for s in (0.25, 0.35, 0.5, 0.75)))
    return F.array_sort(F.array_union(near, far))


def diagonals(points: DataFrame) -> DataFrame:
    """The bounding box and its diagonal of each cloud."""
    a = points.groupBy("cloud_id").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    return a.withColumn("diagonal", F.sqrt(sum(F.pow(F.col(f"{c}_hi") - F.col(f"{c}_lo"), 2) for c in "xyz")))


def watertight(triangles: DataFrame) -> DataFrame:
    """(mesh_id, closed): every edge belongs to two triangles, which run along it in opposite directions, and the triangles around every vertex are one fan."""
    sides = F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("i", "j"), ("j", "k"), ("k", "i")))))
    edges = triangles.select("mesh_id", sides.alias("e")).select("mesh_id", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"), F.signum(F.col("e.b") - F.col("e.a")).alias("way"))
    edges = edges.groupBy("mesh_id", "a", "b").agg(((F.count("*") == 2) & (F.sum("way") == 0) & (F.max("way") == 1)).alias("good"))
    good = edges.groupBy("mesh_id").agg(F.bool_and("good").alias("closed"))
    return good.join(fans(triangles).hint("merge"), "mesh_id").select("mesh_id", (F.col("closed") & F.col("fan")).alias("closed"))


def fans(triangles: DataFrame) -> DataFrame:
    """(mesh_id, fan): at each vertex, the sides that face it lead from triangle to triangle through all of them and back. A vertex at a time is held."""
    corners = F.explode(F.array(*(F.struct(F.col(v).alias("v"), F.col(a).alias("a"), F.col(b).alias("b")) for v, a, b in (("i", "j", "k"), ("j", "k", "i"), ("k", "i", "j")))))
    rows = triangles.select("mesh_id", corners.alias("c")).select("mesh_id", "c.*").repartition("mesh_id", "v").sortWithinPartitions("mesh_id", "v")

    def one_way_round(sides: list[tuple[int, int]]) -> bool:
        after, start = dict(sides), sides[0][0]
        at, n = after[start], 1
        while at != start and at in after and n < len(sides):
            at, n = after[at], n + 1
        return at == start and n == len(sides) == len(after)

    def run(batches):
        now, sides, out = None, [], []
        for batch in batches:
            for mesh, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (mesh, v) != now:
                    if sides:
                        out.append((now[0], one_way_round(sides)))
                    now, sides = (mesh, v), []
                sides.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], batch.schema.field(0).type), pa.array([x for _, x in out])], ["mesh_id", "fan"])
                out = []
        if sides:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([one_way_round(sides)])], ["mesh_id", "fan"])

    kind = to_arrow_schema(triangles.select("mesh_id").schema)[0].type
    return rows.mapInArrow(run, f"mesh_id {triangles.schema['mesh_id'].dataType.simpleString()}, fan boolean").groupBy("mesh_id").agg(F.bool_and("fan").alias("fan"))


def cornered(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """triangles with their corners' coordinates (ix, iy, iz, jx .. kz).

    Spark guesses the size of rows that an explode made by the file below them, so the sides of such
    joins are hinted: else it would gather all vertices in the driver to send them.
    """
    for n in "ijk":
        corner = vertices.select("mesh_id", F.col("vid").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xyz"))
        triangles = triangles.join(corner.hint("merge"), ["mesh_id", n])
    return triangles


def shape_descriptors(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """volume (closed meshes only), surface area, compactness, aspect ratio, hull ratio (always NaN) and counts; NaN under 4 vertices."""
    t = cornered(triangles, vertices)
    p = {n: [F.col(f"{n}{c}") for c in "xyz"] for n in "ijk"}
    sub = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    normal = cross(sub(p["j"], p["i"]), sub(p["k"], p["i"]))
    area = F.sqrt(sum(c * c for c in normal)) / 2
    tetra = sum(a * b for a, b in zip(p["i"], cross(p["j"], p["k"]), strict=True)) / 6
    faces = t.groupBy("mesh_id").agg(F.sum(area).alias("surface_area"), F.abs(F.sum(tetra)).alias("solid"), F.count("*").alias("n_faces"))
    spans = [F.max(c) - F.min(c) for c in "xyz"]
    out = vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"), F.sort_array(F.array(*spans), False).alias("extents")).join(faces.hint("merge"), "mesh_id", "left").join(watertight(triangles).hint("merge"), "mesh_id", "left")
    enough = F.col("n_vertices") >= 4
    longest, shortest = F.get("extents", F.lit(0)), F.get("extents", F.lit(2))
    out = out.withColumn("volume", F.when(enough & F.col("closed"), F.col("solid")).otherwise(NAN)).withColumn("surface_area", F.when(enough, F.coalesce("surface_area", F.lit(0.0))).otherwise(NAN))
    compact = F.when(F.col("surface_area") > 0, 36 * np.pi * F.col("volume") * F.col("volume") / F.pow("surface_area", 3)).otherwise(NAN)
    aspect = F.when(~enough, NAN).when(shortest > 0, longest / shortest).otherwise(float("inf"))
    return out.select("mesh_id", "volume", "surface_area", compact.alias("compactness"), aspect.alias("aspect_ratio"), F.lit(NAN).alias("convex_hull_ratio"), "n_vertices", F.coalesce("n_faces", F.lit(0)).alias("n_faces"))


# The labels, and the bounds that part them.
SPHERE, BOX, LONG, ORGANIC, MIXED, OPEN, NONE = "sphere-like", "box-like / compact", "elongated", "organic / complex surface (animal, plant, etc.)", "irregular / mixed geometry", "unknown (non-watertight)", "unknown (no mesh)"


def shape_label(compactness: Column, aspect: Column) -> Column:
    """Ordered rules; the first that holds decides."""
    return (
        F.when(compactness.isNull() | F.isnan(compactness), OPEN).when(compactness > 0.85, SPHERE).when((compactness > 0.5) & (aspect < 1.5), BOX)
        .when(aspect > 3, LONG).when((compactness < 0.3) & (aspect < 2), ORGANIC).when(aspect > 2, LONG).otherwise(MIXED)
    )


def surface_sample(vertices: DataFrame, triangles: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points per mesh, uniform over its area; a hash of seed and number draws them, so reruns agree.

    A mesh's area is cut into as many equal bins as it has triangles. Points meet the triangles
    of their bin, two on average, and all triangles stand in at most twice as many bins as there are.
    """
    t = cornered(triangles, vertices)
    e, f = ([F.col(f"{m}{c}") - F.col(f"i{c}") for c in "xyz"] for m in "jk")
    area = F.sqrt(F.pow(e[1] * f[2] - e[2] * f[1], 2) + F.pow(e[2] * f[0] - e[0] * f[2], 2) + F.pow(e[0] * f[1] - e[1] * f[0], 2))
    w = W.partitionBy("mesh_id")
    t = t.withColumn("area", area).withColumn("to", F.sum("area").over(w.orderBy("fid").rowsBetween(W.unboundedPreceding, 0)) / F.sum("area").over(w))
    t = t.withColumn("from", F.coalesce(F.lag("to").over(w.orderBy("fid")), F.lit(0.0)))
    digits = lambda salt: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), "mesh_id", "s").cast("binary"))
    unit = lambda salt: (F.conv(F.substring(digits(salt), 1, 11), 16, 10).cast("double") + 1) / float(16**11)
    bins = t.groupBy("mesh_id").agg(F.count("*").alias("bins"))
    t = t.withColumn("bins", F.count("*").over(w)).select("*", F.explode(F.sequence(F.floor(F.col("from") * F.col("bins")), F.floor(F.col("to") * F.col("bins")))).alias("bin")).drop("bins")
    draws = vertices.select("mesh_id").distinct().join(bins.hint("merge"), "mesh_id", "left").select("mesh_id", "bins", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s"))
    draws = draws.withColumn("r", unit(1)).select("mesh_id", "s", "r", F.floor(F.col("r") * F.col("bins")).alias("bin"))
    hit = draws.join(t.hint("merge"), ["mesh_id", "bin"], "left").where("bin IS NULL OR (r > from AND r <= to)").withColumns({"a": F.sqrt(unit(2)), "b": unit(3)})
    spot = [F.coalesce(F.col(f"i{c}") * (1 - F.col("a")) + F.col(f"j{c}") * F.col("a") * (1 - F.col("b")) + F.col(f"k{c}") * F.col("a") * F.col("b"), F.lit(0.0)) for c in "xyz"]
    return hit.select("mesh_id", "s", *(p.alias(c) for p, c in zip(spot, "xyz", strict=True)))


#: The shared layers 3-64-128-1024, and the head 1024-512-256.
LAYERS = ((3, 64), (64, 128), (128, 1024), (1024, 512), (512, 256))


def encoder_weights(seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Random weights of a fixed seed, so that embeddings agree between processes."""
    r = np.random.default_rng(seed)
    return [(r.normal(0, (2 / a) ** 0.5, (a, b)).astype(np.float32), np.zeros(b, np.float32)) for a, b in LAYERS]


def encoded(points: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each point's 1024 features, and the cloud's vector: the largest response over points, then the head. An empty cloud is one point at the origin."""
    x = np.asarray(points, np.float32).reshape(-1, 3) if len(points) else np.zeros((1, 3), np.float32)
    for a, b in weights[:3]:
        x = np.maximum(x @ a + b, 0)
    return x, np.maximum(x.max(0) @ weights[3][0] + weights[3][1], 0) @ weights[4][0] + weights[4][1]


def classified(vector: np.ndarray, head: tuple[np.ndarray, np.ndarray], drop: float = 0.3, r: np.random.Generator | None = None) -> np.ndarray:
    """A linear head's scores of cloud vectors; with a generator, that share of the vector's values is dropped as in training."""
    if r is not None:
        vector = vector * (r.random(vector.shape) >= drop) / (1 - drop)
    return vector @ head[0] + head[1]


def export_weights(spark: SparkSession, weights: list[tuple[np.ndarray, np.ndarray]], path: str) -> None:
    """A row per array: (name, dims, values)."""
    rows = [(f"{i}.{kind}", list(x.shape), x.ravel().tolist()) for i, pair in enumerate(weights) for kind, x in zip(("weight", "bias"), pair, strict=True)]
    spark.createDataFrame(rows, "name string, dims array<int>, values array<float>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, layers: tuple = LAYERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Exported weights; names and shapes must be the layers', no more and no fewer. A prefix before the last two parts of a name is taken off."""
    found = {".".join(r.name.split(".")[-2:]): (tuple(r.dims), r["values"]) for r in spark.read.parquet(path).collect()}
    want = {f"{i}.{kind}": (a, b) if kind == "weight" else (b,) for i, (a, b) in enumerate(layers) for kind in ("weight", "bias")}
    if {k: d for k, (d, _) in found.items()} != want:
        raise ValueError(f"the weights' names or shapes differ: {sorted(set(want.items()) ^ {(k, d) for k, (d, _) in found.items()})}")
    return [tuple(np.array(found[f"{i}.{kind}"][1], np.float32).reshape(want[f"{i}.{kind}"]) for kind in ("weight", "bias")) for i in range(len(layers))]


def encode_clouds(clouds: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]] | None = None, features: bool = False) -> DataFrame:
    """(cloud_id, embedding, features) of dense clouds (cloud_id, points array<array<double>>) by one pass of the network; features, those of each point, are null unless asked for."""
    w = weights or encoder_weights()

    def run(it):
        for pdf in it:
            both = [encoded(np.stack([np.asarray(q, np.float32) for q in p]) if len(p) else np.zeros((0, 3)), w) for p in pdf.points]
            yield pdf[["cloud_id"]].assign(embedding=[v for _, v in both], features=[[*f] if features else None for f, _ in both])

    return clouds.select("cloud_id", "points").mapInPandas(run, "cloud_id long, embedding array<float>, features array<array<float>>")


def norm(vector: Column) -> Column:
    """The Euclidean length of an array."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def feature_colours(features: DataFrame, column: str = "features") -> DataFrame:
    """`r`, `g`, `b` from 0 to 1: the first three principal components of an array column, each stretched over its range (0 where it has none).

    A component's sign is the one that makes its largest loading positive. Only the
    covariance of the columns, whose number the encoder fixes, reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = features.withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))
    axes = PCA(k=3, inputCol="__v", outputCol="__p").fit(rows).pc.toArray()
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(3)] < 0, -1.0, 1.0)
    dot = lambda k: F.aggregate(F.zip_with(F.col(column).cast("array<double>"), F.array(*map(F.lit, axes[:, k].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = features.withColumns({c: dot(k) for k, c in enumerate("rgb")})
    ends = rows.agg(*(f(c).alias(f"{c}_{n}") for c in "rgb" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    span = lambda c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")).otherwise(1.0)
    return rows.join(F.broadcast(ends)).withColumns({c: (F.col(c) - F.col(f"{c}_lo")) / span(c) for c in "rgb"}).drop(*ends.columns)  # ends is one row

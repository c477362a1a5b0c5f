"""Made scenes: primitive meshes, their placement, whole frames with truth, and samples of point clouds.

A frame's draws come from one generator per frame, seeded by the run's seed and the frame's
number, so a recomputed task or another partitioning gives the same frame.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import parsing
from .corruption import EDGE, normal, unit
from .geometry import Intrinsics, lift_box
from .scene import Camera, LIGHT, cast, shade

# The parts of each category, in units of an object's scale.
# box: width, height, depth; ball: radius; tube and cone: radius, height; ring: radius, thickness. Then the part's place, squeeze and quarter turn.
PARTS = {
    "box": [("box", (1, 1, 1))], "sphere": [("ball", (0.5,))], "cylinder": [("tube", (0.35, 1.2))], "cone": [("cone", (0.4, 1.2))], "torus": [("ring", (0.4, 0.12))],
    "mug": [("tube", (0.3, 0.7)), ("ring", (0.22, 0.05), (0.3, 0, 0), None, "x")], "bottle": [("tube", (0.22, 1.6))], "bowl": [("ball", (0.5,), (0, 0, 0), (1, 0.45, 1))],
    "plate": [("tube", (0.7, 0.08))], "table": [("box", (2, 0.12, 1.2))], "chair": [("box", (1, 0.12, 1)), ("box", (1, 0.9, 0.1), (0, 0.5, -0.45))],
    "lamp": [("tube", (0.06, 1.2)), ("cone", (0.35, 0.4), (0, 0.7, 0))], "book": [("box", (0.7, 0.12, 1))], "phone": [("box", (0.35, 0.08, 0.7))],
    "keyboard": [("box", (1.6, 0.08, 0.55))], "monitor": [("box", (1.4, 0.9, 0.12))], "plant": [("tube", (0.25, 0.4)), ("ball", (0.4,), (0, 0.55, 0))],
    "pillow": [("ball", (0.63,))], "drill": [("box", (0.35, 0.35, 1.1)), ("tube", (0.06, 0.5), (0, 0, 0.7), None, "z")], "screwdriver": [("tube", (0.08, 1.4))],
}
CATEGORIES = tuple(PARTS)
#: Objects of a scene, tries to place one, the least distance of two on the ground, and the ground's extent.
OBJECTS, TRIES, APART, GROUND = (3, 10), 40, 0.28, ((-0.7, 0.7), (-0.3, 0.9))
SCALE, COLOUR, ALONE = (0.08, 0.22), (0.2, 0.9), (0.6, 0.5, 0.4)


def grid_faces(rows: int, columns: int) -> list[tuple[int, int, int]]:
    """Triangles between rows of a sheet whose columns close to a ring."""
    at = lambda i, j: i * columns + j % columns
    return [t for i in range(rows - 1) for j in range(columns) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i, j + 1), at(i + 1, j), at(i + 1, j + 1)))]


def turned(profile: list[tuple[float, float]], around: int) -> tuple[np.ndarray, np.ndarray]:
    """A closed body from (radius, height) points, the first and last on the axis, turned about y; tips are single vertices."""
    angle = 2 * np.pi * np.arange(around) / around
    rings = np.array([(r * np.cos(a), h, r * np.sin(a)) for r, h in profile[1:-1] for a in angle])
    n, k = len(profile) - 2, len(rings)
    faces = grid_faces(n, around) + [(k, j, (j + 1) % around) for j in range(around)] + [(k + 1, (n - 1) * around + (j + 1) % around, (n - 1) * around + j) for j in range(around)]
    return np.vstack([rings, [(0, profile[0][1], 0), (0, profile[-1][1], 0)]]), np.array(faces)[:, [0, 2, 1]]


def primitive(kind: str, size: tuple[float, ...], around: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles) of one body around the origin."""
    if kind == "box":
        v = np.array([(x, y, z) for z in (-1, 1) for y in (-1, 1) for x in (-1, 1)]) * np.array(size) / 2
        return v, np.array([(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)])
    if kind == "ball":
        (r,) = size
        return turned([(r * np.sin(a), r * np.cos(a)) for a in np.linspace(0, np.pi, around + 1)], around)
    if kind == "tube":
        r, h = size
        return turned([(0, h / 2), (r, h / 2), (r, -h / 2), (0, -h / 2)], around)
    if kind == "cone":
        r, h = size
        return turned([(0, h), (r, 0), (0, 0)], around)
    if kind == "ring":
        big, thin = size
        angle = 2 * np.pi * np.arange(around) / around
        v = np.array([((big + thin * np.cos(b)) * np.cos(a), (big + thin * np.cos(b)) * np.sin(a), thin * np.sin(b)) for a in angle for b in angle])
        return v, np.array(grid_faces(around + 1, around)) % (around * around)
    raise ValueError(f"no such body: {kind}")


def asset(category: str, scale: float, stretch: tuple[float, float, float] = (1, 1, 1)) -> tuple[np.ndarray, np.ndarray]:
    """A category's mesh, its vertices' mean on the y axis and its base on the ground. Only a plain box is stretched."""
    if category not in PARTS:
        raise KeyError(f"unknown category {category!r}")
    vertices, faces, n = [], [], 0
    for kind, size, *more in PARTS[category]:
        place, squeeze, turn = (*more, *(None,) * (3 - len(more)))
        v, f = primitive(kind, size)
        v = v * (squeeze or 1) * (stretch if category == "box" else 1)
        v = v[:, [0, 2, 1]] * (1, -1, 1) if turn == "x" else v[:, [1, 0, 2]] * (-1, 1, 1) if turn == "z" else v
        vertices.append(v + np.array(place or (0, 0, 0)))
        faces.append(f + n)
        n += len(v)
    v = np.concatenate(vertices) * scale
    v = v - v.mean(0)
    return v - (0, v[:, 1].min(), 0), np.concatenate(faces)


def library(n: int = len(CATEGORIES)) -> tuple[str, ...]:
    if not 0 < n <= len(CATEGORIES):
        raise ValueError(f"there are {len(CATEGORIES)} categories, not {n}")
    return CATEGORIES[:n]


def placed(r: np.random.Generator, categories: tuple[str, ...] = CATEGORIES, most: int = OBJECTS[1]) -> list[dict]:
    """Objects (category, scale, stretch, x, z, yaw, colour) of a scene. One that finds no place far enough from the others is left out; a scene has one at least."""
    out: list[dict] = []
    for _ in range(int(r.integers(OBJECTS[0], most + 1))):
        thing = {"category": str(r.choice(categories)), "scale": float(r.uniform(*SCALE)), "stretch": r.uniform(0.7, 1.3, 3).tolist()}
        for _ in range(TRIES):
            x, z, yaw = float(r.uniform(*GROUND[0])), float(r.uniform(*GROUND[1])), float(r.uniform(0, 2 * np.pi))
            if all(np.hypot(x - o["x"], z - o["z"]) >= APART for o in out):
                out.append({**thing, "x": x, "z": z, "yaw": yaw, "colour": r.uniform(*COLOUR, 3).tolist()})
                break
    if not out:
        out.append({"category": str(r.choice(categories)), "scale": float(r.uniform(*SCALE)), "stretch": [1.0, 1.0, 1.0], "x": 0.0, "z": 0.0, "yaw": 0.0, "colour": [*ALONE]})
    return out


def posed(o: dict) -> tuple[np.ndarray, np.ndarray]:
    v, f = asset(o["category"], o["scale"], tuple(o["stretch"]))
    c, s, centre = np.cos(o["yaw"]), np.sin(o["yaw"]), v.mean(0)
    return (v - centre) @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + centre + (o["x"], 0, o["z"]), f


def held_out(categories: tuple[str, ...], share: float) -> frozenset[str]:
    """The categories that training never sees: the first by SHA-1."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    return frozenset(sorted(categories, key=lambda c: hashlib.sha1(c.encode()).hexdigest())[: max(1, round(share * len(categories)))])


def corrupt(depth: np.ndarray, void_ratio: float, noise: float, bleed: int, seed: int) -> np.ndarray:
    """The dense form of corruption.corrupted, with a generator's draws."""
    r, h, w = np.random.default_rng(seed), *depth.shape
    out = np.where(depth > 0, np.maximum(0, depth + noise * depth**2 * r.normal(size=depth.shape)), np.maximum(depth, 0))
    step = np.max(np.abs(np.gradient(depth)), 0) > EDGE if min(h, w) > 1 else np.zeros(depth.shape, bool)
    k = max(int(bleed), 1)
    wide = np.pad(step, ((k // 2, k - 1 - k // 2), (k // 2, k - 1 - k // 2)))
    edge = np.lib.stride_tricks.sliding_window_view(wide, (k, k)).any((2, 3))
    out[edge] = 0
    left = int(depth.size * void_ratio) - int(edge.sum())
    if left > 0:
        out.flat[r.choice(depth.size, left, replace=False)] = 0
    return out


FRAME = (
    "frame_id long, h int, w int, rgb binary, clean array<float>, corrupted array<float>, instance array<int>, category string, query_text string, bbox_2d array<int>, aabb_3d array<array<double>>, "
    "aabb_3d_lifted_clean array<array<double>>, intrinsics array<double>, split string, corruption_params struct<void_ratio: double, noise_std_1m: double, edge_bleed_px: int, seed: bigint>, objects string"
)


def frame(number: int, seed: int, camera: Camera, categories: tuple[str, ...], hidden: frozenset[str], most: int) -> tuple:
    r = np.random.default_rng((seed, number))
    objects = placed(r, categories, most)
    meshes = [posed(o) for o in objects]
    corners = np.concatenate([v[f] for v, f in meshes])
    owner = np.repeat(np.arange(len(meshes)), [len(f) for _, f in meshes])
    depth, instance, rgb = shade(camera, corners, owner, np.array([o["colour"] for o in objects]), cast, LIGHT)
    seen = [i for i in range(len(objects)) if (instance == i + 1).any()]
    target = seen[int(r.integers(0, len(seen)))] if seen else 0
    ys, xs = np.nonzero(instance.reshape(camera.h, camera.w) == target + 1)
    box = (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else (0, 0, 8, 8)
    cam = (meshes[target][0] - np.array(camera.eye)) @ camera.axes.T
    a, b = cam.min(0), cam.max(0)
    truth = [[float((a, b)[i][0]), float((a, b)[j][1]), float((a, b)[k][2])] for k in (0, 1) for j in (0, 1) for i in (0, 1)]
    clean = depth.reshape(camera.h, camera.w).astype(float)
    lifted = lift_box(clean, Intrinsics(*camera.intrinsics), box)
    params = {"void_ratio": float(r.uniform(0.3, 0.8)), "noise_std_1m": float(r.uniform(0.01, 0.04)), "edge_bleed_px": int(r.integers(2, 6)), "seed": int(r.integers(0, 2**31 - 1))}
    bad = corrupt(clean, params["void_ratio"], params["noise_std_1m"], params["edge_bleed_px"], params["seed"])
    name, rest = objects[target]["category"], [o["category"] for i, o in enumerate(objects) if i != target]
    if rest and r.random() < 0.4:
        query = str(r.choice(parsing.RELATIONS)).format(category=name, other=rest[int(r.integers(0, len(rest)))])
    else:
        query = str(r.choice(parsing.QUERIES)).format(category=name)
    return (
        number, camera.h, camera.w, rgb, depth.astype(np.float32).tolist(), bad.ravel().astype(np.float32).tolist(), instance.tolist(), name, query, list(box), truth,
        lifted and lifted[4], list(map(float, camera.intrinsics)), "heldout" if name in hidden else "train", params, json.dumps(objects),
    )


def frames(spark: SparkSession, n: int, camera: Camera, seed: int = 0, categories: int = len(CATEGORIES), holdout: float = 0.2, most: int = OBJECTS[1], partitions: int | None = None) -> DataFrame:
    """n frames with their truth, each made by itself, spread over the tasks."""
    names = library(categories)
    hidden, schema = held_out(names, holdout), StructType.fromDDL(FRAME)
    if n <= 0:
        raise ValueError("a corpus needs frames")
    kind = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                row = frame(i, seed, camera, names, hidden, most)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kind, strict=True)], schema=kind)

    return spark.range(0, n, 1, partitions or max(1, min(n, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, schema)


def visible(instances: DataFrame, objects: DataFrame) -> DataFrame:
    """objects (frame_id, place) of which any pixel (frame_id, instance = place + 1) is seen."""
    seen = instances.where("instance > 0").select("frame_id", (F.col("instance") - 1).alias("place")).distinct()
    return objects.join(seen, ["frame_id", "place"], "left_semi")


# samples of clouds (cloud_id, pt_id, x, y, z)

def draws(seed: int, *keys: str) -> Column:
    """32 hex digits from a seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(str(int(seed))), *keys).cast("binary"))


def subsample(points: DataFrame, n: int, seed: int = 0, key: str = "cloud_id") -> DataFrame:
    """At most n points of each cloud, drawn without replacement by a hash; all of a smaller one. First each task keeps its own n, so a large cloud isn't gathered."""
    rows = points.withColumn("__d", draws(seed, key, "pt_id"))
    deal = W.partitionBy(key, F.pmod(F.xxhash64("pt_id"), F.lit(64))).orderBy("__d", "pt_id")
    rows = rows.withColumn("__r", F.row_number().over(deal)).where(F.col("__r") <= n)
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__d", "pt_id"))).where(F.col("__r") <= n).drop("__d", "__r")


def strided(points: DataFrame, n: int, key: str = "cloud_id") -> DataFrame:
    """Every k-th point in order, k so that about n of a cloud are left."""
    w = W.partitionBy(key)
    rows = points.withColumns({"__r": F.row_number().over(w.orderBy("pt_id")) - 1, "__n": F.count("*").over(w)})
    k = F.greatest(F.lit(1), F.floor(F.col("__n") / F.least(F.col("__n"), F.lit(n))))
    return rows.where(F.pmod(F.col("__r"), k) == 0).drop("__r", "__n")


def augmented(points: DataFrame, seed: int = 0, jitter: float = 0.01, scale: tuple[float, float] = (0.8, 1.2)) -> DataFrame:
    """Each cloud turned about z by one angle and scaled by one factor, and each coordinate moved by normal noise, all drawn by a hash."""
    rows = points.withColumns({"__c": draws(seed, "cloud_id"), **{f"__{c}": draws(seed + k + 1, "cloud_id", "pt_id") for k, c in enumerate("xyz")}})
    angle, factor = unit(F.col("__c"), 1) * 2 * np.pi, scale[0] + (scale[1] - scale[0]) * unit(F.col("__c"), 12)
    x, y, z = (F.col(c) for c in "xyz")
    moved = {"x": F.cos(angle) * x - F.sin(angle) * y, "y": F.sin(angle) * x + F.cos(angle) * y, "z": z}
    return rows.withColumns({c: (v + jitter * normal(F.col(f"__{c}"))) * factor for c, v in moved.items()}).drop("__c", *(f"__{c}" for c in "xyz"))


def fuzzy_order(points: DataFrame, n: int, seed: int = 0, fuzz: float = 0.06) -> DataFrame:
    """At most n points of each cloud with `place`, from the largest y down, after y was moved by up to fuzz."""
    rows = subsample(points, n, seed).withColumn("__y", F.col("y") + (2 * unit(draws(seed + 1, "cloud_id", "pt_id"), 1) - 1) * fuzz)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("cloud_id").orderBy(F.desc("__y"), "pt_id"))).drop("__y")


def spiked(points: DataFrame, chosen: Column, seed: int = 0, reach: tuple[float, float] = (1.2, 2.8)) -> DataFrame:
    """`spike` of the chosen points: z moved away from the median of the cloud's z by a factor drawn by a hash."""
    centre = points.groupBy("cloud_id").agg(F.median("z").alias("__m"))
    by = reach[0] + (reach[1] - reach[0]) * unit(draws(seed, "cloud_id", "pt_id"), 1)
    return points.join(centre, "cloud_id").withColumn("spike", F.when(chosen, F.col("__m") + (F.col("z") - F.col("__m")) * by)).drop("__m")

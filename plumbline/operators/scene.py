"""Pinhole views of triangle meshes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..core import spread
from .shape import cornered

#: Colour where no ray hits, the least light on a surface, and the direction of light.
BACKGROUND, AMBIENT, LIGHT = 0.85, 0.05, (0.3, 0.8, -0.4)
#: Pairs of ray and triangle that are worked out at once, and pixels of pictures that a task holds before it hands them on.
PAIRS, PIXELS = 1 << 16, 1 << 17


@dataclass(frozen=True)
class Camera:
    h: int
    w: int
    fov: float = 60.0
    eye: tuple[float, float, float] = (0.0, 0.55, -1.15)
    target: tuple[float, float, float] = (0.0, 0.15, 0.2)

    def __post_init__(self):
        if self.h < 1 or self.w < 1 or not 0 < self.fov < 180:
            raise ValueError("a camera needs pixels and an opening between 0 and 180 degrees")

    @property
    def intrinsics(self) -> tuple[float, float, float, float]:
        f = 0.5 * self.w / math.tan(math.radians(self.fov) / 2)
        return f, f, self.w / 2, self.h / 2

    @property
    def axes(self) -> np.ndarray:
        """Rows: the camera's x, y and z in the world. z looks at the target, y is near the world's y."""
        z = np.subtract(self.target, self.eye)
        z = z / np.linalg.norm(z)
        x = np.cross((0.0, 1.0, 0.0), z)
        x = x / np.linalg.norm(x)
        return np.stack([x, np.cross(z, x), z])

    def rays(self) -> np.ndarray:
        """h x w directions in the world, one deep along z, so that a hit's distance is its depth."""
        fx, fy, cx, cy = self.intrinsics
        v, u = np.mgrid[: self.h, : self.w] + 0.5
        return np.stack([(u - cx) / fx, (v - cy) / fy, np.ones_like(u)], -1) @ self.axes


def camera_boxes(vertices: DataFrame, camera: Camera) -> DataFrame:
    """(mesh_id, x_lo .. z_hi): the box around each mesh in the camera's frame."""
    moved = [sum((F.col(c) - float(e)) * float(a) for c, e, a in zip("xyz", camera.eye, axis, strict=True)) for axis in camera.axes]
    return vertices.groupBy("mesh_id").agg(*(f(m).alias(f"{c}_{n}") for m, c in zip(moved, "xyz", strict=True) for f, n in ((F.min, "lo"), (F.max, "hi"))))


def cast(rays: np.ndarray, eye: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest hit of each ray (inf if none) and its triangle's number (-1), from n x 3 x 3 corners; a tie goes to the first."""
    d = rays.reshape(-1, 3)
    best, which, ray = np.full(len(d), np.inf), np.full(len(d), -1), np.arange(len(d))
    step = max(1, PAIRS // max(1, len(d)))
    for first in range(0, len(corners), step):
        a, b, c = (corners[first : first + step, k] for k in range(3))
        e, f, s = b - a, c - a, eye - a
        q = np.cross(s, e)
        det = d @ np.cross(f, e).T
        with np.errstate(divide="ignore", invalid="ignore"):
            i, j, t = d @ np.cross(f, s).T / det, d @ q.T / det, (f * q).sum(1) / det
            t[~((np.abs(det) > 1e-12) & (i >= 0) & (j >= 0) & (i + j <= 1) & (t > 0))] = np.inf
        k = t.argmin(1)
        t = t[ray, k]
        hit = t < best
        best[hit], which[hit] = t[hit], first + k[hit]
    return best, which


def shade(camera: Camera, corners: np.ndarray, owner: np.ndarray, colours: np.ndarray, cast=cast, light: tuple = LIGHT) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(depth, instance, rgb) of one view, pixel after pixel. A surface's light is the cosine of its normal to the light, within AMBIENT to 1."""
    depth, k = cast(camera.rays(), np.asarray(camera.eye), corners)
    seen = np.flatnonzero(k >= 0)
    instance, rgb = np.zeros(len(k), np.int32), np.full((len(k), 3), BACKGROUND)
    edge = corners[:, 1:] - corners[:, :1]
    across = np.cross(edge[:, 0], edge[:, 1])
    lit = across @ (np.asarray(light) / np.linalg.norm(light)) / np.maximum(np.linalg.norm(across, axis=1), 1e-8)
    mine = np.asarray(owner, np.int32)[k[seen]]
    instance[seen] = mine + 1
    rgb[seen] = colours[mine] * np.clip(lit, AMBIENT, 1)[k[seen]][:, None]
    return np.where(k >= 0, depth, 0).astype(np.float32), instance, (np.clip(rgb, 0, 1) * 255).astype(np.uint8).tobytes()


def render(scenes: DataFrame, camera: Camera) -> DataFrame:
    """(frame_id, h, w, depth, instance, rgb) of scenes (frame_id, corners, owner, colours): nine numbers a triangle,
    its object's number from 0, and three numbers from 0 to 1 an object. Depth and instance are 0 where nothing is hit."""
    step = max(1, PIXELS // (camera.h * camera.w))

    def run(it):
        for pdf in (x[k : k + step] for x in it for k in range(0, len(x), step)):
            out = [shade(camera, np.asarray(c, float).reshape(-1, 3, 3), np.asarray(o, np.int32), np.asarray(p, float).reshape(-1, 3)) for c, o, p in zip(pdf.corners, pdf.owner, pdf.colours, strict=True)]
            depth, instance, rgb = zip(*out, strict=True)
            yield pdf[["frame_id"]].assign(h=camera.h, w=camera.w, depth=list(depth), instance=list(instance), rgb=list(rgb))

    # by a hash of the frame: by the frame itself, a shuffle that scenes() ends with would stand for this one, and its few bytes would be joined to few tasks
    return spread(scenes.select("frame_id", "corners", "owner", "colours"), F.xxhash64("frame_id")).mapInPandas(run, "frame_id long, h int, w int, depth array<float>, instance array<int>, rgb binary")


def scenes(objects: DataFrame, vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Scenes for render() from objects (frame_id, mesh_id, place from 0, colour array of three); a scene must fit a task."""
    t = objects.join(cornered(triangles, vertices).hint("merge"), "mesh_id").select("frame_id", F.struct("place", "fid", F.array(*(f"{n}{c}" for n in "ijk" for c in "xyz")).alias("c")).alias("t"))
    faces = t.groupBy("frame_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    colours = objects.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("place", "colour"))).alias("o"))
    out = colours.join(faces.hint("merge"), "frame_id", "left").withColumn("t", F.coalesce("t", F.array().cast(faces.schema["t"].dataType)))
    return out.select("frame_id", F.flatten("t.c").alias("corners"), F.col("t.place").alias("owner"), F.flatten("o.colour").alias("colours"))

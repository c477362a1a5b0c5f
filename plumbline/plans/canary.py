"""Health checks before compute is spent."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

log = logging.getLogger(__name__)
MIN_IOU = 0.30


class Halt(RuntimeError):
    """Names the checks that failed."""

    def __init__(self, names: list[str]):
        super().__init__(f"canary checks failed: {names}")
        self.names = names


def assert_healthy(checks: Mapping[str, Callable[[], bool]]) -> None:
    """Runs every check, also behind a failed one; one that raises has failed."""
    if not checks:
        raise ValueError("at least one check is needed")
    failed = []
    for name, check in checks.items():
        try:
            ok = bool(check())
        except Exception:
            log.exception("check %s raised", name)
            ok = False
        if not ok:
            failed.append(name)
    if failed:
        raise Halt(failed)


def median_iou(iou: Column, lifted: Column) -> Column:
    """The median over frames with a lift; 0 without any."""
    return F.coalesce(F.median(F.when(lifted, iou)), F.lit(0.0))


def iou_check(rows: DataFrame, least: float = MIN_IOU) -> Callable[[], bool]:
    """A check on evaluation rows (iou_3d, success) of clean frames."""
    return lambda: rows.agg(median_iou(F.col("iou_3d"), F.col("success")).alias("m")).first().m >= least

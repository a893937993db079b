"""Blocks' coordinates in names: ``base_xxxxx-XXXXX_yyyyy-YYYYY_zzzzz-ZZZZZ``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = ("x0", "x1", "y0", "y1", "z0", "z1")


def format_block_id(base: str | None = None) -> Column:
    """The name of a row with columns z0, z1, y0, y1, x0, x1."""
    name = F.format_string("%05d-%05d_%05d-%05d_%05d-%05d", *[F.col(b) for b in BOUNDS])
    return F.concat(F.lit(f"{base}_"), name) if base else name


def parse_block_id(name: Column, offset: tuple[int, int, int] = (0, 0, 0)) -> dict[str, Column]:
    """Columns z0, z1, y0, y1, x0, x1 read from a name, less an offset (z, y, x)."""
    pattern = r"(\d+)-(\d+)_(\d+)-(\d+)_(\d+)-(\d+)$"
    shift = {"x": offset[2], "y": offset[1], "z": offset[0]}
    return {b: F.regexp_extract(name, pattern, i + 1).cast("int") - shift[b[0]] for i, b in enumerate(BOUNDS)}

"""A clustered layout for box queries: rows in the order of an interleaved cell code, boxes as a few code ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
STEP = 0.01  #: degrees of a cell


def _cell(x: Column, low: float) -> Column:
    return F.least(F.greatest(F.floor(F.round((x - low) / STEP, 9)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def spread(x: Column) -> Column:
    """The bits of a 16-bit number at the even places of a 32-bit one."""
    # Shifts and masks of the usual bit-interleaving steps.
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def code(lat: Column, lon: Column) -> Column:
    """Interleaved cell code: near places mostly have near codes. Null where a coordinate is."""
    return spread(_cell(lat, -90.0)).bitwiseOR(F.shiftleft(spread(_cell(lon, -180.0)), 1))


def write(rows: DataFrame, path: str, files: int) -> None:
    """rows(lat, lon, ...) in ranges of the code; rows without a place come first."""
    coded = rows.withColumn("code", code(F.col("lat"), F.col("lon")))
    coded.repartitionByRange(files, "code").sortWithinPartitions("code").write.mode("overwrite").parquet(path)


def ranges(west: float, south: float, east: float, north: float, most: int = 16) -> list[tuple[int, int]]:
    """At most ``most`` inclusive code ranges that cover a box: quarters of the plane that lie inside, and those on its border as far down as the number allows."""
    top = (1 << BITS) - 1
    cell = lambda x, low: min(max(math.floor(round((x - low) / STEP, 9)), 0), top)
    y0, y1, x0, x1 = cell(south, -90.0), cell(north, -90.0), cell(west, -180.0), cell(east, -180.0)
    squares = [(0, 0, BITS)]  # lowest cells and bits of a side
    for _ in range(BITS):
        below = []
        for y, x, bits in squares:
            side = 1 << bits
            if bits == 0 or (y0 <= y and y + side - 1 <= y1 and x0 <= x and x + side - 1 <= x1):
                below.append((y, x, bits))
                continue
            half = side >> 1
            below += [(v, u, bits - 1) for v in (y, y + half) for u in (x, x + half) if v <= y1 and v + half - 1 >= y0 and u <= x1 and u + half - 1 >= x0]
        if below == squares or len(_joined(below)) > most:
            break
        squares = below
    return _joined(squares)


def _joined(squares: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    interleave = lambda y, x: sum(((y >> i) & 1) << (2 * i) | ((x >> i) & 1) << (2 * i + 1) for i in range(BITS))
    out: list[tuple[int, int]] = []
    for low in sorted((interleave(y, x), bits) for y, x, bits in squares):
        a, b = low[0], low[0] + (1 << (2 * low[1])) - 1
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def inside(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of a clustered table inside a box, borders included: the code ranges let the scan skip row groups, the coordinates decide."""
    near = F.lit(False)
    for a, b in ranges(west, south, east, north):
        near |= F.col("code").between(a, b)
    return rows.where(near & F.col("lat").between(south, north) & F.col("lon").between(west, east)).drop("code")

"""Column expressions over positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skywake import constants as K


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """True inside the box, bounds included."""
    return lat.between(south, north) & lon.between(west, east)


def in_region(lat: Column, lon: Column, region: K.Region) -> Column:
    return in_box(lat, lon, region.lat_min, region.lon_min, region.lat_max, region.lon_max)


def longitude_bin(lon: Column) -> Column:
    """Bin of 5 degrees from -180; 180 itself lies beyond the last bin."""
    return F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(K.LONGITUDE_BINS))


def world_x(lon: Column, zoom: int) -> Column:
    """Horizontal Web-Mercator pixel at a zoom level."""
    return (lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(K.TILE_PX * 2**zoom))


def world_y(lat: Column, zoom: int) -> Column:
    """Vertical Web-Mercator pixel; latitudes are held to the limits of the projection."""
    held = F.greatest(F.least(lat, F.lit(85.0511287798)), F.lit(-85.0511287798))
    sine = F.sin(held * F.lit(math.pi) / F.lit(180.0))
    merc = F.log((F.lit(1.0) + sine) / (F.lit(1.0) - sine)) / F.lit(4 * math.pi)
    return (F.lit(0.5) - merc) * F.lit(float(K.TILE_PX * 2**zoom))


#: Cells of level 0 are 2^11 degrees wide, those of each further level half as wide; what lies beyond counts to the outermost.
WIDEST_POWER, OUTERMOST, FINEST_LEVEL = 11, 1024.0, 26


def cell_of(degrees: Column, level: Column) -> Column:
    """Number of the cell of a level that a latitude or longitude lies in.

    It never falls as the degrees rise, and scaling by a power of two is exact, so cells strictly between those of two bounds
    lie strictly between the bounds.
    """
    held = F.greatest(F.least(degrees, F.lit(OUTERMOST)), F.lit(-OUTERMOST))
    return F.floor(held * F.pow(F.lit(2.0), level - F.lit(WIDEST_POWER)))


def z_order(lat: Column, lon: Column, bits: int = 16) -> Column:
    """Place on the Z curve: the bits of longitude and latitude, of 2^``bits`` steps each, in turn; longitude first."""
    steps = 2**bits - 1
    x = F.floor(F.greatest(F.least((lon + F.lit(180.0)) / F.lit(360.0), F.lit(1.0)), F.lit(0.0)) * F.lit(steps))
    y = F.floor(F.greatest(F.least((lat + F.lit(90.0)) / F.lit(180.0), F.lit(1.0)), F.lit(0.0)) * F.lit(steps))
    return F.shiftleft(_spread(x, bits), 1).bitwiseOR(_spread(y, bits))


def _spread(number: Column, bits: int) -> Column:
    """The bits of a number with a zero between each two."""
    parts = [F.shiftleft(number.bitwiseAND(F.lit(1 << k)), k) for k in range(bits)]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return total


def z_ranges(south: float, west: float, north: float, east: float, bits: int = 16, most: int = 32) -> list[tuple[int, int]]:
    """First and last places of at most ``most`` stretches of the Z curve that cover a box, in order; none for an empty box.

    Squares of the curve that lie half in the box are split, the largest first, as long as there may be more stretches.
    """
    if not (south <= north and west <= east):
        return []
    steps = 2**bits - 1
    at = lambda share: math.floor(min(max(share, 0.0), 1.0) * steps)
    x0, x1, y0, y1 = at((west + 180.0) / 360.0), at((east + 180.0) / 360.0), at((south + 90.0) / 180.0), at((north + 90.0) / 180.0)
    whole: list[tuple[int, int]] = []
    split = [(bits, 0, 0, 0)]  # size as a power, corner, place of the corner

    def outside(square: tuple) -> bool:
        size, x, y, _ = square
        return x > x1 or y > y1 or x + 2**size - 1 < x0 or y + 2**size - 1 < y0

    def inside(square: tuple) -> bool:
        size, x, y, _ = square
        return x0 <= x and x + 2**size - 1 <= x1 and y0 <= y and y + 2**size - 1 <= y1

    while split and len(whole) + len(split) + 3 <= most:
        size, x, y, z = split.pop(0)
        half = 2 ** (size - 1) if size else 0
        if not size or inside((size, x, y, z)):
            whole.append((z, z + 4**size - 1))
            continue
        parts = [(size - 1, x + dx * half, y + dy * half, z + (2 * dx + dy) * half * half) for dx in (0, 1) for dy in (0, 1)]
        split += [part for part in parts if not outside(part)]
    found = sorted(whole + [(z, z + 4**size - 1) for size, _, _, z in split])
    joined: list[tuple[int, int]] = []
    for first, last in found:
        if joined and first == joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], last)
        else:
            joined.append((first, last))
    return joined

"""Values to [0, 1], color tables by control points, axis ticks, Morton keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control points (place, r, g, b).
TABLES = {
    "dense": [(0.0, 0.26, 0.22, 0.92), (0.1, 0.0, 0.0, 0.52), (0.2, 0.0, 1.0, 1.0), (0.3, 0.0, 0.5, 0.0), (0.4, 1.0, 1.0, 0.0), (0.5, 0.6, 0.47, 0.0), (0.6, 1.0, 0.47, 0.0), (0.7, 0.61, 0.18, 0.0), (0.8, 1.0, 0.03, 0.17), (0.9, 0.63, 0.12, 0.34), (1.0, 1.0, 0.4, 1.0)],
    "grey": [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0)],
    "blue": [(0.0, 0.0, 0.0, 0.0), (0.33, 0.0, 0.0, 0.5), (0.66, 0.0, 0.5, 1.0), (1.0, 1.0, 1.0, 1.0)],
    "orange": [(0.0, 0.0, 0.0, 0.0), (0.33, 0.5, 0.0, 0.0), (0.66, 1.0, 0.5, 0.0), (1.0, 1.0, 1.0, 1.0)],
    "temperature": [(0.05, 0.0, 0.0, 1.0), (0.35, 0.0, 1.0, 1.0), (0.5, 1.0, 1.0, 1.0), (0.65, 1.0, 1.0, 0.0), (0.95, 1.0, 0.0, 0.0)],
    "rainbow": [(0.0, 0.0, 0.0, 1.0), (0.2, 0.0, 1.0, 1.0), (0.45, 0.0, 1.0, 0.0), (0.55, 0.7, 1.0, 0.0), (0.6, 1.0, 1.0, 0.0), (0.75, 1.0, 0.5, 0.0), (0.9, 1.0, 0.0, 0.0), (0.98, 1.0, 0.0, 0.5), (1.0, 1.0, 0.0, 1.0)],
    "levels": [(0.0, 0.0, 0.0, 1.0), (0.2, 0.0, 0.0, 1.0), (0.2, 0.0, 1.0, 1.0), (0.4, 0.0, 1.0, 1.0), (0.4, 0.0, 1.0, 0.0), (0.6, 0.0, 1.0, 0.0), (0.6, 1.0, 1.0, 0.0), (0.8, 1.0, 1.0, 0.0), (0.8, 1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0)],
    "thermal": [(0.0, 0.3, 0.0, 0.0), (0.25, 1.0, 0.0, 0.0), (0.5, 1.0, 1.0, 0.0), (0.55, 0.8, 0.55, 0.2), (0.6, 0.6, 0.37, 0.4), (0.65, 0.4, 0.22, 0.6), (0.75, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0)],
    "IsoL": [(0.0, 0.9102, 0.2236, 0.8997), (0.2, 0.4027, 0.3711, 1.0), (0.4, 0.0422, 0.5904, 0.5899), (0.6, 0.0386, 0.6206, 0.0201), (0.8, 0.5441, 0.5428, 0.011), (1.0, 1.0, 0.2288, 0.1631)],
}
#: The ColorBrewer schemes with the most classes, as hexadecimal colors at even places.
BREWER = """
Accent 7fc97f beaed4 fdc086 ffff99 386cb0 f0027f bf5b17 666666
Blues f7fbff deebf7 c6dbef 9ecae1 6baed6 4292c6 2171b5 08519c 08306b
BrBG 543005 8c510a bf812d dfc27d f6e8c3 f5f5f5 c7eae5 80cdc1 35978f 01665e 003c30
BuGn f7fcfd e5f5f9 ccece6 99d8c9 66c2a4 41ae76 238b45 006d2c 00441b
BuPu f7fcfd e0ecf4 bfd3e6 9ebcda 8c96c6 8c6bb1 88419d 810f7c 4d004b
Dark2 1b9e77 d95f02 7570b3 e7298a 66a61e e6ab02 a6761d 666666
GnBu f7fcf0 e0f3db ccebc5 a8ddb5 7bccc4 4eb3d3 2b8cbe 0868ac 084081
Greens f7fcf5 e5f5e0 c7e9c0 a1d99b 74c476 41ab5d 238b45 006d2c 00441b
Greys ffffff f0f0f0 d9d9d9 bdbdbd 969696 737373 525252 252525 000000
Oranges fff5eb fee6ce fdd0a2 fdae6b fd8d3c f16913 d94801 a63603 7f2704
OrRd fff7ec fee8c8 fdd49e fdbb84 fc8d59 ef6548 d7301f b30000 7f0000
Paired a6cee3 1f78b4 b2df8a 33a02c fb9a99 e31a1c fdbf6f ff7f00 cab2d6 6a3d9a ffff99 b15928
Pastel1 fbb4ae b3cde3 ccebc5 decbe4 fed9a6 ffffcc e5d8bd fddaec f2f2f2
Pastel2 b3e2cd fdcdac cbd5e8 f4cae4 e6f5c9 fff2ae f1e2cc cccccc
PiYG 8e0152 c51b7d de77ae f1b6da fde0ef f7f7f7 e6f5d0 b8e186 7fbc41 4d9221 276419
PRGn 40004b 762a83 9970ab c2a5cf e7d4e8 f7f7f7 d9f0d3 a6dba0 5aae61 1b7837 00441b
PuBu fff7fb ece7f2 d0d1e6 a6bddb 74a9cf 3690c0 0570b0 045a8d 023858
PuBuGn fff7fb ece2f0 d0d1e6 a6bddb 67a9cf 3690c0 02818a 016c59 014636
PuOr 7f3b08 b35806 e08214 fdb863 fee0b6 f7f7f7 d8daeb b2abd2 8073ac 542788 2d004b
PuRd f7f4f9 e7e1ef d4b9da c994c7 df65b0 e7298a ce1256 980043 67001f
Purples fcfbfd efedf5 dadaeb bcbddc 9e9ac8 807dba 6a51a3 54278f 3f007d
RdBu 67001f b2182b d6604d f4a582 fddbc7 f7f7f7 d1e5f0 92c5de 4393c3 2166ac 053061
RdGy 67001f b2182b d6604d f4a582 fddbc7 ffffff e0e0e0 bababa 878787 4d4d4d 1a1a1a
RdPu fff7f3 fde0dd fcc5c0 fa9fb5 f768a1 dd3497 ae017e 7a0177 49006a
RdYlBu a50026 d73027 f46d43 fdae61 fee090 ffffbf e0f3f8 abd9e9 74add1 4575b4 313695
RdYlGn a50026 d73027 f46d43 fdae61 fee08b ffffbf d9ef8b a6d96a 66bd63 1a9850 006837
Reds fff5f0 fee0d2 fcbba1 fc9272 fb6a4a ef3b2c cb181d a50f15 67000d
Set1 e41a1c 377eb8 4daf4a 984ea3 ff7f00 ffff33 a65628 f781bf 999999
Set2 66c2a5 fc8d62 8da0cb e78ac3 a6d854 ffd92f e5c494 b3b3b3
Set3 8dd3c7 ffffb3 bebada fb8072 80b1d3 fdb462 b3de69 fccde5 d9d9d9 bc80bd ccebc5 ffed6f
Spectral 9e0142 d53e4f f46d43 fdae61 fee08b ffffbf e6f598 abdda4 66c2a5 3288bd 5e4fa2
YlGn ffffe5 f7fcb9 d9f0a3 addd8e 78c679 41ab5d 238443 006837 004529
YlGnBu ffffd9 edf8b1 c7e9b4 7fcdbb 41b6c4 1d91c0 225ea8 253494 081d58
YlOrBr ffffe5 fff7bc fee391 fec44f fe9929 ec7014 cc4c02 993404 662506
YlOrRd ffffcc ffeda0 fed976 feb24c fd8d3c fc4e2a e31a1c bd0026 800026
"""


def _scheme(colors: list[str]) -> list[tuple[float, ...]]:
    """Control points of hexadecimal colors at even places, to four digits."""
    return [(round(k / (len(colors) - 1), 4), *(round(b / 255, 4) for b in bytes.fromhex(c))) for k, c in enumerate(colors)]


TABLES |= {name: _scheme(colors) for name, *colors in map(str.split, BREWER.split("\n")[1:-1])}
#: Other names of tables; sharp is not smooth.
NAMES = {"": "dense", "default": "dense", "sharp": "dense", "gray": "grey"}


def reverse(table: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
    return [(1 - p, *c) for p, *c in reversed(table)]


def normalize(value: Column, low: Column, high: Column, log: bool = False) -> Column:
    """(v - low) / (high - low), 0.5 if there is no range; log: by logarithms, clamped to [0, 1], 0 where not positive."""
    if not log:
        return F.when(high > low, (value - low) / (high - low)).otherwise(0.5)
    f = (F.ln(value) - F.ln(low)) / (F.ln(high) - F.ln(low))
    return F.when((value <= 0) | (low <= 0), 0.0).when(high > low, F.greatest(F.least(f, F.lit(1.0)), F.lit(0.0))).otherwise(0.5)


def color(t: Column, table: list[tuple[float, ...]], smooth: bool = True) -> list[Column]:
    """r, g, b at t: linear between control points, or that of the nearer one; outside, the end's."""
    out = []
    table = [(float(p), *c) for p, *c in table]
    for c in range(1, 4):
        e = F.lit(table[-1][c])
        for a, b in reversed(list(zip(table, table[1:]))):
            if a[0] == b[0]:
                continue
            mid = (a[0] + b[0]) / 2
            inside = F.lit(a[c]) + (F.lit(b[c]) - F.lit(a[c])) * (t - F.lit(a[0])) / F.lit(b[0] - a[0]) if smooth else F.when(t < mid, a[c]).otherwise(b[c])
            e = F.when(t < b[0], inside).otherwise(e)
        out.append(F.when(t <= table[0][0], F.lit(table[0][c])).otherwise(e))
    return out


def ticks(low: float, high: float, about: int = 5, log: bool = False) -> tuple[list[float], list[float]]:
    """Major and minor ticks: 1, 2 or 5 times a power of ten apart; log: powers of ten and their multiples."""
    if log:
        a, b = math.floor(math.log10(low)), math.ceil(math.log10(high))
        major = [10.0**k for k in range(a, b + 1) if low <= 10.0**k <= high]
        return major, [m * 10.0**k for k in range(a, b + 1) for m in range(2, 10) if low <= m * 10.0**k <= high]
    if high <= low:
        return [low], []
    raw = (high - low) / about
    unit = 10 ** math.floor(math.log10(raw))
    step = next(s * unit for s in (1, 2, 5, 10) if s * unit >= raw * 0.999)
    at = lambda d: [k * d for k in range(math.ceil(low / d - 1e-9), math.floor(high / d + 1e-9) + 1)]
    major = at(step)
    return major, [m for m in at(step / 5) if all(abs(m - x) > step / 100 for x in major)]


def morton(cols: list[Column], bits: int = 10) -> Column:
    """Interleaved bits of non-negative integers, the first column's lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for d, c in enumerate(cols):
            out = out + F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(cols) + d)
    return out

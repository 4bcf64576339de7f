"""Points laid out along a space-filling curve, so that a box reads few row groups.

Latitude and longitude are cut into a grid whose cells are numbered by interleaving the bits
of both (Z-order), which keeps near cells near. A box becomes a bounded number of ranges of
cell numbers; files outside them are skipped by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logscope.functions.numbers import latitude, longitude

#: Bits of a coordinate; cells of about 600 metres.
BITS = 16
RANGES = 32
# The steps that spread 16 bits over the even places of 32.
_STEPS = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _cell(value: Column, low: float, span: float) -> Column:
    at = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(1 << BITS)))
    return F.least(F.greatest(at, F.lit(0)), F.lit((1 << BITS) - 1)).cast("bigint")


def _spread(x: Column) -> Column:
    for shift, mask in _STEPS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def cell_number(point: Column) -> Column:
    """The Z-order number of the cell of a ``"lat,lon"`` text; null without one."""
    lat, lon = latitude(point), longitude(point)
    return F.shiftleft(_spread(_cell(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_cell(lon, -180.0, 360.0)))


def write_by_place(df: DataFrame, path: str, point: str, parts: int | None = None,
                   mode: str = "errorifexists") -> None:
    """Write a table in cell order, with the columns ``_cell``, ``_lat`` and ``_lon``."""
    at = F.col(point)
    placed = df.withColumns({"_cell": cell_number(at), "_lat": latitude(at), "_lon": longitude(at)})
    placed.repartitionByRange(*([parts] if parts else []), "_cell").sortWithinPartitions("_cell").write.mode(
        mode).parquet(path)


def _grid(value: float, low: float, span: float) -> int:
    return min(max(int((value - low) // (span / (1 << BITS))), 0), (1 << BITS) - 1)


def box_ranges(low: tuple[float, float], high: tuple[float, float], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of cell numbers that cover a box between two corners; at most ``most``.

    Quarters of the grid are split until each lies wholly in the box or no more ranges may
    be told apart; neighbours are joined. A range may reach beyond the box, never short of it.
    """
    rows = (_grid(low[0], -90.0, 180.0), _grid(high[0], -90.0, 180.0))
    columns = (_grid(low[1], -180.0, 360.0), _grid(high[1], -180.0, 360.0))
    if rows[0] > rows[1] or columns[0] > columns[1]:
        return []
    # (row, column, bits): a quarter of side 2**bits, whose numbers are one range.
    quarters = [(0, 0, BITS)]

    def meets(r: int, c: int, side: int) -> bool:
        return r <= rows[1] and r + side > rows[0] and c <= columns[1] and c + side > columns[0]

    def inside(r: int, c: int, side: int) -> bool:
        return rows[0] <= r and r + side - 1 <= rows[1] and columns[0] <= c and c + side - 1 <= columns[1]

    while True:
        done = [q for q in quarters if q[2] == 0 or inside(q[0], q[1], 1 << q[2])]
        cut = [q for q in quarters if q not in done]
        finer = [(r + dr, c + dc, b - 1) for r, c, b in cut for dr in (0, 1 << (b - 1)) for dc in (0, 1 << (b - 1))
                 if meets(r + dr, c + dc, 1 << (b - 1))]
        if not cut or len(_joined(done + finer)) > most:
            return _joined(quarters)
        quarters = done + finer


def _joined(quarters: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    ranges: list[tuple[int, int]] = []
    for first, last in sorted(_numbers(*q) for q in quarters):
        if ranges and ranges[-1][1] + 1 == first:
            ranges[-1] = (ranges[-1][0], last)
        else:
            ranges.append((first, last))
    return ranges


def _numbers(row: int, column: int, bits: int) -> tuple[int, int]:
    first = sum(((row >> i & 1) << 2 * i + 1) | ((column >> i & 1) << 2 * i) for i in range(BITS))
    return first, first + (1 << 2 * bits) - 1


def in_placed_box(table: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Rows of a table written by :func:`write_by_place` inside a box, edges included."""
    at = F.col("_cell")
    near = F.lit(False)
    for first, last in box_ranges(low, high):
        near = near | at.between(first, last)
    exact = F.col("_lat").between(low[0], high[0]) & F.col("_lon").between(low[1], high[1])
    return table.where(near & exact).drop("_cell", "_lat", "_lon")

"""Styles: inheritance along chains, adoption from a template, table style parts.
A null property is one that a style does not set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inherited(styles: DataFrame, id_: str, parent: str, props: list[str], depth: int = 64) -> DataFrame:
    """Every style with its properties resolved: its own, else the nearest ancestor's.
    Pointers double, so a chain of depth d takes log2(d) joins; a chain longer than
    depth, or a circle, ends at depth."""
    now = styles.select(F.col(id_), F.col(parent).alias("_up"), *props)
    step = 1
    while step < depth:
        up = now.select(F.col(id_).alias("_id"), F.col("_up").alias("_next"), *[F.col(p).alias(f"_{p}") for p in props])
        joined = now.join(up, F.col("_up") == F.col("_id"), "left")
        after = joined.select(id_, F.col("_next").alias("_up"), *[F.coalesce(p, f"_{p}").alias(p) for p in props])
        step *= 2
        now = after
        if step >= 4 and not now.where("_up is not null").limit(1).count():
            break
    return now.drop("_up")


def adopted(own: DataFrame, template: DataFrame, name: str, kind: str, props: list[str]) -> DataFrame:
    """A document's styles after taking a template's: of one name and kind the
    template's properties win; of one name and another kind the own stay; from
    is own, template or both."""
    t = template.select(F.col(name).alias("_n"), F.col(kind).alias("_k"), *[F.col(p).alias(f"_{p}") for p in props])
    both = own.join(t, F.col(name) == F.col("_n"), "full_outer")
    taken = F.col(name).isNull() | F.coalesce(F.col(kind) == F.col("_k"), F.lit(False))
    source = F.when(F.col(name).isNull(), "template").when(F.col("_n").isNull(), "own").when(taken, "both").otherwise("own")
    return both.select(
        F.coalesce(name, "_n").alias(name),
        F.coalesce(kind, "_k").alias(kind),
        *[F.when(taken, F.col(f"_{p}")).otherwise(F.col(p)).alias(p) for p in props],
        source.alias("from"),
    )


def cell_parts(row: F.Column, col: F.Column, rows: F.Column, last: F.Column, row_band: int = 1, col_band: int = 1, without: tuple[str, ...] = ()) -> F.Column:
    """All parts of a table style that a cell takes, weakest first, as an array. last: the
    cell is its row's last; without: what the table's look leaves out, of first_row,
    last_row, first_col, last_col, band_v, band_h. Bands count from behind a header."""
    on = lambda name: F.lit(name not in without)
    top, left = on("first_row") & (row == 0), on("first_col") & (col == 0)
    bottom, right = on("last_row") & (row == rows - 1) & (rows > 1), on("last_col") & last & (col > 0)
    r, c = row - int("first_row" not in without), col - int("first_col" not in without)
    band = lambda k, size, way: F.when(F.floor(k / size) % 2 == 1, f"band2_{way}").otherwise(f"band1_{way}")
    corner = {"nw": top & left, "ne": top & right, "sw": bottom & left, "se": bottom & right}
    edges = {"first_col": left, "last_col": right, "first_row": top, "last_row": bottom} | corner
    bands = [F.when(on("band_v") & (c >= 0), band(c, col_band, "v")), F.when(on("band_h") & (r >= 0), band(r, row_band, "h"))]
    return F.array_compact(F.array(F.lit("whole"), *bands, *[F.when(test, name) for name, test in edges.items()]))


def merged(parts: F.Column, value_of: dict) -> F.Column:
    """A property of the strongest part that sets it; null if none does."""
    values = F.create_map(*[F.lit(x) for pair in value_of.items() for x in pair])
    return F.try_element_at(F.array_compact(F.transform(parts, lambda p: F.try_element_at(values, p))), F.lit(-1))


#: A table style's parts, weakest first; a later part overrides an earlier one.
PARTS = ["whole", "band_col", "band_row", "first_col", "last_col", "first_row", "last_row", "corner"]


def table_part(row: F.Column, col: F.Column, rows: F.Column, cols: F.Column, band: int = 1, header: bool = True, first_col: bool = True) -> F.Column:
    """The strongest part that a cell belongs to. Bands leave out the header row and
    the first column; a last row needs a second row."""
    top, left, right = row == 0, col == 0, col == cols - 1
    bottom = (row == rows - 1) & (rows > 1)
    r, c = row - int(header), col - int(first_col)
    return (
        F.when((top | bottom) & (left | right), "corner")
        .when(bottom, "last_row")
        .when(top & F.lit(header), "first_row")
        .when(right, "last_col")
        .when(left & F.lit(first_col), "first_col")
        .when(F.floor(r / band) % 2 == 1, "band_row")
        .when(F.floor(c / band) % 2 == 1, "band_col")
        .otherwise("whole")
    )

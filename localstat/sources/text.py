"""Readers for the text formats: matrices, value lists and result tuples.

One rule for all: blank lines are dropped (they count in line numbers), and a field that is
missing or no number is null, or no edge in a matrix. :func:`bad_cells` lists such cells.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from localstat.functions.scalars import node_key
from localstat.operators.topology import symmetrise
from localstat.plans.scale import materialise, sized

# Lines of a matrix with at most this many ones are cut at them.
FEW_ONES = 1_000


def _numbered(spark, path, per_file):
    """Lines with their 0-based number, counted over all files or within each.

    Each file split counts its own lines; a running total over the splits (one small
    row per split) turns that into a global number without moving lines to one task.
    """
    split = ["_file", "_start"]
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_file").orderBy("_start") if per_file else Window.orderBy(*split)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    splits = materialise(splits.select(*split, "_first", "_base"), "splits")  # a row per file split
    return lines.join(sized(splits), split).select(
        F.col("_file").alias("file"),
        (F.col("_base") + F.col("_id") - F.col("_first")).alias("line"),
        "value",
    )


def _not_blank(lines):
    return lines.where(F.trim("value") != "")


def read_lines(spark, path):
    """Text lines with their number ``line`` over all files in name order."""
    return _numbered(spark, path, per_file=False).drop("file")


def read_node_files(spark, path):
    """One file per node, named by its 0-based number, ``v;`` per tick -> node, tick, value."""
    return _not_blank(_numbered(spark, path, per_file=True)).select(
        (F.regexp_extract("file", r"(\d+)\.[^/]*$", 1).try_cast("bigint") + 1).alias("node"),
        F.col("line").alias("tick"),
        F.trim(F.split("value", ";")[0]).try_cast("double").alias("value"),
    )


def _ones(cells):
    """Numbers, from 1, of the cells that are 1."""
    return F.filter(F.transform(cells, lambda c, i: F.when(F.trim(c).try_cast("int") == 1, i + 1)), lambda i: i.isNotNull())


def _few_ones(pieces):
    """The same for cells of one character, out of the text between the ones."""
    before = F.slice(pieces, 1, F.size(pieces) - 1)
    at = F.aggregate(
        before, F.array().cast("array<int>"),
        lambda found, piece: F.array_append(found, F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(-1)) + 1 + F.length(piece)),
    )
    return F.transform(at, lambda i: F.shiftright(i, 1) + 1)


def read_adjacency(spark, path):
    """Edges of a 0/1 matrix, one comma-separated line per node.

    Only entries below the diagonal count; each gives both directions. The ones are picked
    out of a line before it is exploded. Cells that are no number count as 0; see
    :func:`bad_cells`. A line of plain 0 and 1 with few ones, such as those of large sparse graphs,
    is compared with zeros as a whole and cut at its ones instead of into its cells.
    """
    n = F.col("line").cast("int")
    rows = read_lines(spark, path).withColumn("_head", F.substring("value", F.lit(1), n * 2))
    rows = rows.withColumn("_pieces", F.split("_head", "1", FEW_ONES + 2))
    plain = F.startswith(F.repeat(F.lit("0,"), n), F.replace("_head", F.lit("1"), F.lit("0")))
    few = plain & (F.size("_pieces") <= FEW_ONES + 1)
    ones = F.when(few, _few_ones(F.col("_pieces"))).otherwise(_ones(F.slice(F.split("value", ","), 1, n)))
    lower = rows.select((F.col("line") + 1).alias("src"), F.explode(ones).alias("dst"))
    return symmetrise(lower.select("src", F.col("dst").cast("bigint").alias("dst")))


def bad_cells(spark, path, separator=",", kind="int"):
    """Cells that are not empty and no number, as ``line, position, cell``, all counted from 0."""
    cells = read_lines(spark, path).select("line", F.posexplode(F.split("value", separator)).alias("position", "cell"))
    return cells.where((F.trim("cell") != "") & F.trim("cell").try_cast(kind).isNull())


def read_keyed_values(spark, path):
    """``node7_42;0.31`` lines -> node, count (may be null), value; the last one wins.

    Lines without a node are dropped.
    """
    key, value = F.split("value", ";")[0], F.get(F.split("value", ";"), F.lit(1))
    rows = _not_blank(read_lines(spark, path)).select(
        "line",
        node_key(F.split(key, "_")[0]).alias("node"),
        F.try_element_at(F.split(key, "_"), F.lit(2)).alias("count"),
        F.trim(value).try_cast("double").alias("value"),
    )
    last = F.max_by("value", "line").alias("value")
    return rows.where("node IS NOT NULL").groupBy("node", "count").agg(last)


def read_wide_values(spark, path):
    """``v1;v2;...;vn;`` lines, one per tick -> tick, node (its column), value."""
    return (
        read_lines(spark, path)
        .select("line", F.posexplode(F.split("value", ";")).alias("_pos", "_cell"))
        .where("_cell <> ''")
        .select(
            F.col("line").alias("tick"),
            (F.col("_pos") + 1).cast("bigint").alias("node"),
            F.trim("_cell").try_cast("double").alias("value"),
        )
    )


def read_tuples(spark, path, columns):
    """``(a,b)`` or ``(a,(b,c))`` lines -> the named, typed columns.

    ``columns`` is a list of (name, type); all parentheses are dropped. Folders of a
    partitioned result add their partition columns.
    """
    fields = F.split(F.translate("value", "()", ""), ",")
    lines = _not_blank(spark.read.text(path))
    extra = [c for c in lines.columns if c != "value"]
    cell = lambda i: F.trim(F.get(fields, F.lit(i)))
    return lines.select(*extra, *[cell(i).try_cast(t).alias(name) for i, (name, t) in enumerate(columns)])


def read_tuple_sets(spark, path):
    """``(7,List(3, 12, 5))`` lines -> node, draw-less sets as ``members``."""
    lines = _not_blank(spark.read.text(path))
    extra = [c for c in lines.columns if c != "value"]
    listed = F.split(F.regexp_extract("value", r"List\(([^)]*)\)", 1), ",")
    members = F.transform(listed, lambda m: F.trim(m).try_cast("bigint"))
    return lines.select(
        *extra,
        F.regexp_extract("value", r"^\((\d+),", 1).try_cast("bigint").alias("node"),
        F.filter(members, lambda m: m.isNotNull()).alias("members"),
    )

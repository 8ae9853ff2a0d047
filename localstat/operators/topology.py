"""Neighbour graphs as edge tables ``(src, dst)``, one row per direction."""

from pyspark.sql import functions as F

from localstat.plans.scale import running_weight


def symmetrise(edges):
    """Both directions of every edge, without self loops or repeats."""
    both = edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return both.where("src <> dst").distinct()


def ranked_neighbours(edges, hot_rows=None):
    """Each node's neighbours numbered from 0 in order of their id."""
    ranked = running_weight(edges.select("src", "dst"), ["src"], ["dst"], "pos", hot_rows=hot_rows)
    return ranked.withColumn("pos", F.col("pos") - 1)


def max_degree(edges):
    return edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0


def node_map(edges, longest=10_000):
    """Node -> sorted list of its neighbours, as ``node, part, neighbours``.

    A list has at most ``longest`` neighbours; a hub has several rows, numbered by ``part``
    from 0 and sorted over all parts, so no row grows with the graph.
    """
    placed = edges.select("src", "dst", F.lit(0).cast("bigint").alias("pos"))
    if max_degree(edges) > longest:
        placed = ranked_neighbours(edges)
    part = F.floor(F.col("pos") / longest)
    return placed.groupBy(F.col("src").alias("node"), part.alias("part")).agg(
        F.sort_array(F.collect_list("dst")).alias("neighbours")
    )


def dense_ids(nodes):
    """Nodes numbered 1..N in order of their id, as ``node, id``; null ids are left out.

    The Monte Carlo functions address nodes by number: renumber readings and edges whose ids
    have gaps with :func:`renumbered`.
    """
    known = nodes.select("node").where("node is not null").distinct().withColumn("_all", F.lit(0))
    return running_weight(known, ["_all"], ["node"], "id").select("node", "id")


def renumbered(df, ids, *columns):
    """Replace node ids in ``columns`` by their numbers; rows with an unknown id are dropped."""
    for c in columns:
        numbers = ids.select(F.col("node").alias(c), F.col("id").alias("_id"))
        df = df.join(numbers, c).drop(c).withColumnRenamed("_id", c)
    return df


def grid_edges(nodes, width):
    """Rook contiguity: nodes 1..N laid out row by row on a grid of ``width`` columns."""
    node, column = F.col("node"), (F.col("node") - 1) % width
    candidates = nodes.select(
        node.alias("src"),
        F.explode(
            F.array(
                node - width,
                node + width,
                F.when(column > 0, node - 1),
                F.when(column < width - 1, node + 1),
            )
        ).alias("dst"),
    ).where("dst >= 1")
    return candidates.join(nodes.select(node.alias("dst")), "dst", "left_semi").select("src", "dst")


def undirected_links(edges):
    """Each undirected edge once, from the lower to the higher node."""
    return edges.where("src < dst").select("src", "dst")


def assign_stations(nodes, n_stations):
    """Deal nodes 1..N round-robin to stations 1..n; N must be a multiple of n."""
    count = nodes.count()
    if count % n_stations:
        raise ValueError(f"{count} nodes cannot be divided evenly among {n_stations} stations")
    return nodes.select("node", ((F.col("node") - 1) % n_stations + 1).alias("station"))


# Fixed values of the drawing: longest edge, side of the picture, margin.
MAX_EDGE, PICTURE, MARGIN = 60, 1200, 20


def grid_layout(nodes):
    """Drawing position of every node (numbered from 0) on a square grid."""
    count = nodes.count()
    side = count**0.5
    columns, edge = max(int(side), 1), min(PICTURE / side, MAX_EDGE) if count else MAX_EDGE
    index = F.col("node") - 1
    return nodes.select(
        index.alias("index"),
        (F.floor(index % columns * F.lit(edge)) + MARGIN).alias("x"),
        (F.floor(F.floor(index / columns) * F.lit(edge)) + MARGIN).alias("y"),
    )


def graph_json(nodes, edges):
    """Node and link objects of the drawing, one JSON text per row."""
    node_rows = grid_layout(nodes).select(
        F.lit("nodes").alias("section"),
        F.to_json(
            F.struct(
                F.concat(F.lit("node"), F.col("index").cast("string")).alias("sensorId"),
                F.lit(True).alias("fixed"),
                F.lit(1).alias("group"),
                "x",
                "y",
            )
        ).alias("json"),
    )
    link_rows = undirected_links(edges).select(
        F.lit("links").alias("section"),
        F.to_json(
            F.struct(
                (F.col("src") - 1).alias("source"),
                (F.col("dst") - 1).alias("target"),
                F.lit(1).alias("value"),
            )
        ).alias("json"),
    )
    return node_rows.unionByName(link_rows)


def check_topology(nodes, edges, stations=None, max_degree=4, elements=None):
    """Violations of the topology rules, as rows ``(rule, node, n)``.

    Rules: node ids are unique, a node lists a neighbour at most once and at most
    ``max_degree`` of them, and every node named by an edge or a station exists. With
    ``elements``, one row ``id`` per node and station element, ids such as ``node7`` must be
    unique over all of them; ``node`` is then the number in the id.
    """
    known = nodes.select("node").distinct()

    def violations(rule, rows):
        return rows.select(F.lit(rule).alias("rule"), "node", F.col("count").alias("n"))

    def unknown(rule, refs):
        return violations(rule, refs.join(known, "node", "left_anti").groupBy("node").count())

    pairs = edges.groupBy(F.col("src").alias("node"), "dst").count()
    found = [
        violations("duplicate_id", nodes.groupBy("node").count().where("count > 1")),
        violations(
            "duplicate_neighbour",
            pairs.groupBy("node")
            .agg(F.count_if(F.col("count") > 1).alias("count"))
            .where("count > 0"),
        ),
        violations(
            "degree",
            pairs.groupBy("node").agg(F.sum("count").alias("count")).where(F.col("count") > max_degree),
        ),
        unknown("unknown_source", edges.select(F.col("src").alias("node"))),
        unknown("unknown_neighbour", edges.select(F.col("dst").alias("node"))),
    ]
    if stations is not None:
        found.append(unknown("unknown_station_node", stations.select("node")))
    if elements is not None:
        repeated = elements.groupBy("id").count().where("count > 1")
        number = F.regexp_extract("id", r"(\d+)$", 1)
        found.append(violations("duplicate_element_id", repeated.withColumn("node", number.try_cast("bigint"))))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result

"""The registered queries as plain SQL over the same tables (DuckDB dialect).

Written from the definitions, not from the operators: neighbour lists are expanded
instead of summed, the grid is a join, and the temporal average runs over all values.
"""

import math

from localstat.functions.rng import PRIME, STEPS
from localstat.plans.registered import K, R, R_TEMPORAL, R_WHOLE, RUNS, SEED

# More draws than the sets written as text need; the first distinct ones do not depend on it.
DRAWS_TEMPORAL = 120

CTES = {
    "readings": "SELECT event_id, ts, CAST(ts AS DATE) AS batch, user_id + 1 AS node, value FROM events",
    "obs": "SELECT batch, node, avg(value) AS value FROM readings GROUP BY batch, node",
    "nodes": "SELECT DISTINCT user_id + 1 AS node FROM events",
    "edges": """
        SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON b.node = a.node - 5
        UNION ALL SELECT a.node, b.node FROM nodes a JOIN nodes b ON b.node = a.node + 5
        UNION ALL SELECT a.node, b.node FROM nodes a JOIN nodes b ON b.node = a.node - 1
          WHERE (a.node - 1) // 5 = (b.node - 1) // 5
        UNION ALL SELECT a.node, b.node FROM nodes a JOIN nodes b ON b.node = a.node + 1
          WHERE (a.node - 1) // 5 = (b.node - 1) // 5""",
    "stats": """
        SELECT batch, count(*) AS n, sum(value) AS total, avg(value) AS mean, stddev_pop(value) AS sd
        FROM obs GROUP BY batch""",
    "z": """
        SELECT o.batch, o.node, (o.value - s.mean) / s.sd AS z FROM obs o JOIN stats s ON o.batch = s.batch""",
    "lags": """
        SELECT z.batch, e.dst AS node, avg(z.z) AS lag FROM z JOIN edges e ON e.src = z.node
        GROUP BY z.batch, e.dst""",
    "lisa": """
        SELECT z.batch, z.node, z.z, l.lag, z.z * l.lag AS lisa
        FROM z JOIN lags l ON l.batch = z.batch AND l.node = z.node""",
    "grouped": "SELECT CAST(ts AS DATE) AS batch, user_id % 15 + 1 AS node, avg(value) AS value FROM events GROUP BY 1, 2",
    "hist": f"""
        SELECT batch, node, list(value) OVER (PARTITION BY node ORDER BY batch
          ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) AS vals FROM obs""",
    "cells": "SELECT batch, node, unnest(range(len(vals))) AS lag, unnest(vals) AS value FROM hist",
    "cells_latest": """
        SELECT batch, node, unnest(range(len(vals))) AS lag, unnest(list_reverse(vals)) AS value FROM hist""",
    "durations": """
        SELECT event_id, ts AS batch, event_type AS run, CAST(2 ** (user_id % 5) AS BIGINT) AS base,
          (user_id // 5) % 5 AS k, CASE user_id % 3 WHEN 0 THEN 'sparse' WHEN 1 THEN 'connected' ELSE 'dense' END
          AS topology, value AS seconds FROM events""",
}
BASE = ["readings", "obs", "nodes", "edges", "stats", "z", "lags", "lisa"]


def sql(select, *names, **extra):
    """A query over named common tables, then extra ones in the given order."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({text})" for n, text in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


def r6(expr, name):
    return f"round({expr}, 6) + 0.0 AS {name}"


# The stream of numbers behind the random sets.


def power(x, step):
    y = f"({x} + {step})"
    y2 = f"({y} * {y} % {PRIME})"
    return f"({y2} * {y2} % {PRIME} * {y} % {PRIME})"


def numbers(source, prefix, extra="", n=5):
    """Chain of tables adding u0 .. u(n-1) to the columns of ``source`` with ``x``."""
    result, last = {}, "x"
    for i in range(n):
        result[f"{prefix}{i}"] = f"SELECT *, {power(last, STEPS[i])} AS u{i} FROM {source}"
        source, last = f"{prefix}{i}", f"u{i}"
    return result


def keyed(source, key):
    digest = f"md5('{SEED}:' || {key})"
    part = {n: f"CAST('0x' || substr({digest}, {start}, 8) AS BIGINT)" for n, start in (("a", 1), ("b", 9), ("c", 17))}
    steps = ", ".join(f"{part[n]} % {PRIME - 1} + 1 AS {n}" for n in "bc")
    parts = f"{part['a']} % {PRIME} AS a, {steps}"
    return f"SELECT *, {parts} FROM {source}"


def picked(source, rank, n, total):
    """Tables ending in ``picked``, with ``y``: a distinct number below ``total`` for each rank below ``n``."""
    high = 2**31
    result = {"streams": f"SELECT *, (a + draw * b) % {PRIME} AS x FROM {source}"} | numbers("streams", "s", n=2)
    result["stretches"] = f"""
        SELECT *, {rank} * ({total} // {n}) + least({rank}, {total} % {n}) AS low,
          ({rank} + 1) * ({total} // {n}) + least({rank} + 1, {total} % {n}) AS up FROM s1"""
    jitter = f"low + (u0 * {high} + u1) % (up - low)"
    return result | {"picked": f"SELECT *, ({jitter} + (b * {high} + c) % {total}) % {total} AS y FROM stretches"}


def choose(n, k):
    """The binomial coefficient of whole numbers, negative ones giving none."""
    product = " * ".join(f"greatest({n} - {i}, 0)::HUGEINT" for i in range(k))
    return f"({product} // {[1, 1, 2, 6, 24][k]})"


def combination(source, by):
    """Tables ending in ``sets``: combination number ``z`` of ``size`` nodes, sizes descending."""
    result, last = {}, source
    for k in (4, 3, 2, 1):
        # The largest n with C(n, k) <= z lies next to the root.
        root = f"CAST(({math.factorial(k)} * z) ** (1.0 / {k}) AS BIGINT) + 5"
        found = f"list_filter([{', '.join(f'{root} - {i}' for i in range(8))}], lambda g: {choose('g', k)} <= z)[1]"
        result[f"pick{k}"] = f"SELECT *, CASE WHEN size >= {k} THEN {found} END AS i{k} FROM {last}"
        result[f"rest{k}"] = f"SELECT * REPLACE (CASE WHEN size >= {k} THEN z - {choose(f'i{k}', k)} ELSE z END AS z) FROM pick{k}"
        last = f"rest{k}"
    shifted = ", ".join(f"i{k} + 1 + CASE WHEN i{k} + 1 >= node THEN 1 ELSE 0 END" for k in (1, 2, 3, 4))
    result["sets"] = f"SELECT {', '.join(by)}, draw, [x FOR x IN [{shifted}] IF x IS NOT NULL] AS members FROM {last}"
    return result


def drawn_sets(source, by, r):
    """Tables ending in ``sets``: r distinct sets of every row of ``source``, sizes in turn."""
    cols = ", ".join(by)
    result = {
        "keyed": keyed(source, " || ':' || ".join(by)),
        "sizes": "SELECT size, " + "CASE size " + " ".join(f"WHEN {k} THEN {choose('others', k)}" for k in (1, 2, 3, 4))
        + " END::BIGINT AS total FROM range(1, 5) t(size), (SELECT count(*) - 1 AS others FROM nodes)",
        # Turn q has a set of every size that has more than q; it starts after all sets of earlier turns.
        "turns": f"""
            SELECT q, s.size, s.total, count(*) FILTER (o.total > q) AS width,
              count(*) FILTER (o.total > q AND o.size < s.size) AS place, sum(least(o.total, q))::BIGINT AS start
            FROM range({r}) t(q), sizes s, sizes o WHERE s.total > q GROUP BY q, s.size, s.total""",
        "most": f"SELECT size, count(*) AS most FROM turns WHERE start < {r} GROUP BY size",
        "tries": f"""
            SELECT {cols}, a, b, c, q, size, total, most, start + ((place - a) % width + width) % width AS draw
            FROM keyed, turns JOIN most USING (size) WHERE start + ((place - a) % width + width) % width < {r}""",
    }
    result |= picked("tries", "q", "most", "total")
    result["numbered"] = f"SELECT {cols}, draw, size, y AS z FROM picked"
    return result | combination("numbered", by)


def tried_sets(source, by, r, draws):
    """Tables ending in ``sets``: the first r distinct ones of independent draws for every row of ``source``."""
    cols = ", ".join(by)
    key = " || ':' || ".join(by)
    result = {
        "keyed": keyed(source, key),
        "tries": f"""
            SELECT {cols}, try, (a + try * b) % {PRIME} AS x, (SELECT count(*) - 1 FROM nodes) AS others
            FROM keyed, range({draws}) t(try)""",
    }
    result |= numbers("tries", "s")
    result["sized"] = f"SELECT *, u0 * 4 // {PRIME} + 1 AS size FROM s4"
    picks = ", ".join(f"u{i + 1} * (others - size + {i + 1}) // {PRIME} AS t{i}" for i in range(4))
    result["picked"] = f"SELECT *, {picks} FROM sized"
    last, names = "picked", []
    for i in range(4):
        repeat = f"CASE WHEN t{i} IN ({', '.join(names)}) THEN others - size + {i} ELSE t{i} END" if names else "t0"
        result[f"floyd{i}"] = f"SELECT *, {repeat} AS m{i} FROM {last}"
        last = f"floyd{i}"
        names.append(f"m{i}")
    shifted = ", ".join(f"m{i} + 1 + CASE WHEN m{i} + 1 >= node THEN 1 ELSE 0 END" for i in range(4))
    result["listed"] = f"SELECT {cols}, try, list_sort(([{shifted}])[1:size]) AS members FROM floyd3"
    result["single"] = f"SELECT {cols}, members, min(try) AS try FROM listed GROUP BY ALL"
    result["sets"] = f"""
        SELECT {cols}, draw, members FROM (
          SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY try) - 1 AS draw FROM single
        ) WHERE draw < {r}"""
    return result


def enumerated(source, r, others=14):
    """Tables ending in ``sets`` for a small graph: all its sets in keyed order, the first r."""
    totals = [math.comb(others, k) for k in (1, 2, 3, 4)]
    below = [sum(totals[:k]) for k in range(5)]
    result = {
        "keyed": keyed(source, "batch || ':' || node"),
        "tries": f"SELECT batch, node, a, b, c, d AS draw FROM keyed, range({min(r, below[4])}) t(d)",
    }
    result |= picked("tries", "draw", min(r, below[4]), below[4])
    size = " ".join(f"WHEN y < {below[k]} THEN {k}" for k in (1, 2, 3, 4))
    first = " ".join(f"WHEN y < {below[k]} THEN {below[k - 1]}" for k in (1, 2, 3, 4))
    result["numbered"] = f"SELECT batch, node, draw, CASE {size} END AS size, y - CASE {first} END AS z FROM picked"
    return result | combination("numbered", ["batch", "node"])


MEANS = {
    "members": "SELECT batch, node, draw, unnest(members) AS member FROM sets",
    "means": """
        SELECT m.batch, m.node, m.draw, avg(z.z) AS mean
        FROM members m LEFT JOIN z ON z.batch = m.batch AND z.node = m.member
        GROUP BY m.batch, m.node, m.draw""",
}
RANKED = {
    "ranked": """
        SELECT l.batch, l.node, l.lisa, count(*) FILTER (l.lisa - l.z * m.mean > 1e-9) AS below,
          count(*) AS n
        FROM lisa l JOIN means m ON m.batch = l.batch AND m.node = l.node
        GROUP BY l.batch, l.node, l.lisa""",
}
RANK_COLUMNS = f"batch, node, below, n, {r6('lisa', 'lisa')}, {r6('(below + 1) / (n + 1)', 'position')}"


def temporal(cells):
    """Tables ending in ``tlisa``: the temporal statistic by expanding all values."""
    return {
        "zs": f"""
            SELECT batch, node, lag, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z
            FROM {cells} WINDOW w AS (PARTITION BY batch, lag)""",
        "pool": """
            SELECT c.batch, e.dst AS node, c.z FROM zs c JOIN edges e ON e.src = c.node
            UNION ALL
            SELECT o.batch, o.node, o.z FROM zs o JOIN edges e ON e.dst = o.node
            JOIN zs c ON c.batch = o.batch AND c.node = e.src AND c.lag = 0 WHERE o.lag > 0""",
        "tlags": "SELECT batch, node, avg(z) AS lag FROM pool GROUP BY batch, node",
        "tlisa": """
            SELECT z.batch, z.node, z.z, l.lag, z.z * l.lag AS lisa
            FROM zs z JOIN tlags l ON l.batch = z.batch AND l.node = z.node WHERE z.lag = 0""",
    }


def temporal_mc(scope):
    tables = {"hist": CTES["hist"], "cells": CTES["cells"], **temporal("cells")}
    tables["targets"] = "SELECT batch, node FROM tlisa"
    tables |= drawn_sets("targets", ["batch", "node"], R_TEMPORAL)
    tables["slots"] = f"""
        SELECT s.batch, s.node, s.draw, p.lag, (k.a + s.draw * k.b + p.lag * k.c) % {PRIME} AS x
        FROM sets s JOIN keyed k ON k.batch = s.batch AND k.node = s.node
        JOIN zs p ON p.batch = s.batch AND p.node = s.node AND p.lag > 0"""
    tables |= numbers("slots", "p")
    tables["past"] = f"""
        SELECT batch, node, draw, lag, u0 * 4 // {PRIME} + 1 AS size,
          unnest([1, 2, 3, 4]) AS slot, unnest([u1, u2, u3, u4]) AS u FROM p4"""
    if scope == "local":
        tables["rank_of"] = """
            SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos,
              count(*) OVER (PARTITION BY src) AS degree FROM edges"""
        picks = f"""
            SELECT p.batch, p.node, p.draw, p.lag, r.dst AS member FROM past p
            JOIN rank_of r ON r.src = p.node AND r.pos = p.u * r.degree // {PRIME} WHERE p.slot <= p.size"""
    else:
        index = f"(u * (SELECT count(*) - 1 FROM nodes) // {PRIME} + 1)"
        picks = f"""
            SELECT batch, node, draw, lag, {index} + CASE WHEN {index} >= node THEN 1 ELSE 0 END AS member
            FROM past WHERE slot <= size"""
    tables["chosen"] = f"SELECT batch, node, draw, 0 AS lag, unnest(members) AS member FROM sets UNION ALL {picks}"
    tables["means"] = """
        SELECT c.batch, c.node, c.draw, avg(z.z) AS mean FROM chosen c
        LEFT JOIN zs z ON z.batch = c.batch AND z.node = c.member AND z.lag = c.lag
        GROUP BY c.batch, c.node, c.draw"""
    tables["ranked"] = RANKED["ranked"].replace("FROM lisa l", "FROM tlisa l")
    return sql(f"SELECT {RANK_COLUMNS} FROM ranked", "readings", "obs", "nodes", "edges", **tables)


def oracle_sql():
    lisa_rows = f"SELECT batch, node, {r6('lisa', 'lisa')} FROM lisa"
    history = ["readings", "obs", "hist"]
    tables = {"temporal": temporal("cells"), "latest": temporal("cells_latest")}
    obs_sets = drawn_sets("obs", ["batch", "node"], R_TEMPORAL)
    listed = "array_to_string(members, ',') AS members"
    simulated = {**obs_sets, **MEANS}
    mc = {**drawn_sets("lisa", ["batch", "node"], R), **MEANS, **RANKED}
    mc_temporal_r = {**drawn_sets("lisa", ["batch", "node"], R_TEMPORAL), **MEANS, **RANKED}
    shared_sets = drawn_sets("nodes", ["node"], R)
    # Sets drawn per node, applied in every batch.
    shared = {
        **shared_sets,
        "means": """
            SELECT l.batch, l.node, s.draw, avg(z.z) AS mean
            FROM lisa l JOIN (SELECT node, draw, unnest(members) AS member FROM sets) s ON s.node = l.node
            LEFT JOIN z ON z.batch = l.batch AND z.node = s.member GROUP BY l.batch, l.node, s.draw""",
        **RANKED,
    }
    small = {"obs": CTES["grouped"], "nodes": "SELECT DISTINCT node FROM obs"}
    small |= {n: CTES[n] for n in BASE[3:]} | enumerated("lisa", R) | MEANS | RANKED
    whole = {"obs": "SELECT DATE '2024-01-01' AS batch, user_id + 1 AS node, avg(value) AS value FROM events GROUP BY 2"}
    whole |= {n: CTES[n] for n in BASE[2:]}
    whole |= drawn_sets("lisa", ["batch", "node"], R_WHOLE) | MEANS | RANKED
    values = ", ".join(f"{r6(f'vals[{i + 1}]', f'v{i}')}" for i in range(K))
    past = ", ".join(f"{r6(f'vals[{i + 1}]', f'p{i}')}" for i in range(1, K))
    day_ms = "CAST(epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS VARCHAR)"
    summary = ", ".join(
        [
            r6("min(seconds)", "min"),
            *[r6(f"quantile_cont(seconds, 0.{q})", f"p{q}") for q in (25, 50, 75)],
            r6("max(seconds)", "max"),
            r6("avg(seconds)", "avg"),
            r6("stddev_pop(seconds)", "std_dev"),
        ]
    )
    files = """
        SELECT * FROM (SELECT batch, event_id % 8 AS file, count(*) AS lines FROM readings GROUP BY 1, 2)
        QUALIFY lines > floor(median(lines) OVER ())"""
    word_rows = """
        SELECT unnest(string_split(rtrim(text, ' '), ' ')) AS word FROM documents
        WHERE length(text) = 0 OR rtrim(text, ' ') <> ''"""
    degree_lisa = {
        "degrees": "SELECT src, count(*) AS degree FROM edges GROUP BY src",
        "around": """
            SELECT z.batch, e.dst AS node, sum(z.z) / max(d.degree) AS lag FROM edges e
            JOIN z ON z.node = e.src JOIN degrees d ON d.src = e.dst GROUP BY z.batch, e.dst""",
        "expected": """
            SELECT z.batch, z.node, z.z * a.lag AS lisa FROM z
            JOIN around a ON a.batch = z.batch AND a.node = z.node""",
    }
    side = "least(1200 / sqrt(n), 60)"
    multi = sql(
        f"SELECT event_id, batch, node, {r6('z * lag', 'lisa')} FROM scored JOIN around USING (batch, node)",
        "readings", "nodes", "edges",
        scored="""
            SELECT event_id, batch, node, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z
            FROM readings WINDOW w AS (PARTITION BY batch)""",
        around="""
            SELECT s.batch, e.dst AS node, avg(s.z) AS lag FROM scored s
            JOIN edges e ON e.src = s.node GROUP BY 1, 2""",
    )

    return {
        "spatial_lisa": sql(
            f"SELECT batch, node, {r6('z', 'z')}, {r6('lag', 'lag')}, {r6('lisa', 'lisa')} FROM lisa", *BASE
        ),
        "batch_count": sql("SELECT batch, n FROM stats", "readings", "obs", "stats"),
        "batch_sum": sql(f"SELECT batch, {r6('total', 'total')} FROM stats", "readings", "obs", "stats"),
        "batch_mean": sql(f"SELECT batch, {r6('mean', 'mean')} FROM stats", "readings", "obs", "stats"),
        "batch_stddev": sql(f"SELECT batch, {r6('sd', 'sd')} FROM stats", "readings", "obs", "stats"),
        "neighbour_mean": sql(
            f"""SELECT o.batch, e.dst AS node, {r6('avg(o.value)', 'mean')}
            FROM obs o JOIN edges e ON e.src = o.node GROUP BY 1, 2""",
            "readings", "obs", "nodes", "edges",
        ),
        "result_counts": sql(
            """SELECT batch, n AS n_values,
            (SELECT count(*) FROM lisa l WHERE l.batch = stats.batch) AS n_lisa FROM stats""",
            *BASE,
        ),
        "word_count": sql("SELECT word, count(*) AS n FROM words GROUP BY word", words=word_rows),
        "standardise": sql(f"SELECT batch, node, {r6('z', 'z')} FROM z", "readings", "obs", "stats", "z"),
        "spatial_lag": sql(f"SELECT batch, node, {r6('lag', 'lag')} FROM lags", *BASE),
        "spatial_lisa_multi": multi,
        "one_per_node": sql(
            """SELECT batch, node, value FROM readings
            QUALIFY row_number() OVER (PARTITION BY batch, node ORDER BY ts DESC, event_id DESC) = 1""",
            "readings",
        ),
        "history_arrays": sql(f"SELECT batch, node, CAST(len(vals) AS INTEGER) AS n, {values} FROM hist", *history),
        "split_history": sql(
            f"""SELECT batch, node, {r6('vals[1]', 'value')}, CAST(len(vals) - 1 AS INTEGER) AS n_past,
            {past} FROM hist""",
            *history,
        ),
        "history_flat": sql(
            f"SELECT batch, node, 'k-' || lag AS label, {r6('value', 'value')} FROM cells", *history, "cells"
        ),
        "lag_stats": sql(
            f"""SELECT batch, CAST(lag AS INTEGER) AS lag, {r6('avg(value)', 'mean')},
            {r6('stddev_pop(value)', 'sd')} FROM cells WHERE lag > 0 GROUP BY batch, lag""",
            *history, "cells",
        ),
        "past_standardise": sql(
            f"""SELECT batch, node, CAST(lag AS INTEGER) AS lag, round(z, 6) + 0.0 AS z FROM (
            SELECT batch, node, lag, CASE WHEN stddev_pop(value) OVER w <> 0
            THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM cells
            WHERE lag > 0 WINDOW w AS (PARTITION BY batch, lag))""",
            *history, "cells",
        ),
        "past_neighbour_values": sql(
            f"""SELECT z.batch, z.node, count(p.z) AS n, {r6('coalesce(sum(p.z), 0)', 'total')}
            FROM (SELECT DISTINCT o.batch, o.node FROM zs o JOIN edges e ON e.dst = o.node
            JOIN zs c ON c.batch = o.batch AND c.node = e.src) z
            LEFT JOIN past_pool p ON p.batch = z.batch AND p.node = z.node GROUP BY z.batch, z.node""",
            "readings", "obs", "nodes", "edges", "hist", "cells",
            zs=tables["temporal"]["zs"],
            past_pool="""
                SELECT c.batch, e.dst AS node, c.z FROM zs c JOIN edges e ON e.src = c.node
                JOIN zs o ON o.batch = c.batch AND o.node = e.dst AND o.lag = 0 WHERE c.lag > 0
                UNION ALL
                SELECT o.batch, o.node, o.z FROM zs o JOIN edges e ON e.dst = o.node
                JOIN zs c ON c.batch = o.batch AND c.node = e.src AND c.lag = 0 WHERE o.lag > 0""",
        ),
        "temporal_lag": sql(
            f"SELECT batch, node, {r6('lag', 'lag')} FROM tlisa",
            "readings", "obs", "nodes", "edges", "hist", "cells", **tables["temporal"],
        ),
        "temporal_lisa": sql(
            f"SELECT batch, node, {r6('lisa', 'lisa')} FROM tlisa",
            "readings", "obs", "nodes", "edges", "hist", "cells", **tables["temporal"],
        ),
        "temporal_lisa_latest": sql(
            f"SELECT batch, node, {r6('lisa', 'lisa')} FROM tlisa",
            "readings", "obs", "nodes", "edges", "hist", "cells_latest", **tables["latest"],
        ),
        "random_sets": sql(
            f"SELECT batch, node, CAST(draw AS INTEGER) AS draw, {listed} FROM sets",
            "readings", "obs", "nodes", **obs_sets,
        ),
        "random_sets_shared": sql(
            f"SELECT node, CAST(draw AS INTEGER) AS draw, {listed} FROM sets", "nodes", **shared_sets
        ),
        "enumerated_sets": sql(
            f"SELECT batch, node, CAST(draw AS INTEGER) AS draw, {listed} FROM sets",
            "grouped", **enumerated("grouped", R),
        ),
        "explode_sets": sql(
            f"SELECT batch, node, CAST(draw AS INTEGER) AS draw, {listed} FROM sets",
            "readings", "obs", "nodes", **obs_sets,
        ),
        "set_members": sql(
            "SELECT batch, node, CAST(draw AS INTEGER) AS draw, unnest(members) AS member FROM sets",
            "readings", "obs", "nodes", **obs_sets,
        ),
        "random_set_mean": sql(
            f"SELECT batch, node, CAST(draw AS INTEGER) AS draw, {r6('mean', 'mean')} FROM means",
            *BASE[:6], **simulated,
        ),
        "simulated_lisa": sql(
            f"""SELECT m.batch, m.node, CAST(m.draw AS INTEGER) AS draw, {r6('z.z * m.mean', 'sim')}
            FROM means m JOIN z ON z.batch = m.batch AND z.node = m.node""",
            *BASE[:6], **simulated,
        ),
        "rank_position": sql(
            f"SELECT batch, node, below, n, {r6('(below + 1) / (n + 1)', 'position')} FROM ranked",
            *BASE, **mc_temporal_r,
        ),
        "spatial_lisa_mc": sql(f"SELECT {RANK_COLUMNS} FROM ranked", *BASE, **mc),
        "spatial_lisa_mc_shared": sql(f"SELECT {RANK_COLUMNS} FROM ranked", *BASE, **shared),
        "spatial_lisa_mc_small": sql(f"SELECT {RANK_COLUMNS} FROM ranked", **small),
        "spatial_lisa_mc_whole": sql(f"SELECT {RANK_COLUMNS} FROM ranked", **whole),
        "temporal_mc_local": temporal_mc("local"),
        "temporal_mc_global": temporal_mc("global"),
        "node_map": sql(
            """SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours
            FROM edges GROUP BY src""",
            "nodes", "edges",
        ),
        "map_to_neighbours": sql(
            f"SELECT o.batch, e.dst AS node, {r6('o.value', 'value')} FROM obs o JOIN edges e ON e.src = o.node",
            "readings", "obs", "nodes", "edges",
        ),
        "station_assignment": "SELECT c_custkey AS node, (c_custkey - 1) % 5 + 1 AS station FROM customer",
        "grid_edges": sql("SELECT src, dst FROM edges", "nodes", "edges"),
        "undirected_links": sql("SELECT src, dst FROM edges WHERE src < dst", "nodes", "edges"),
        "grid_layout": sql(
            f"""SELECT node - 1 AS index,
            CAST(floor((node - 1) % CAST(floor(sqrt(n)) AS BIGINT) * {side}) AS BIGINT) + 20 AS x,
            CAST(floor((node - 1) // CAST(floor(sqrt(n)) AS BIGINT) * {side}) AS BIGINT) + 20 AS y
            FROM nodes, (SELECT count(*) AS n FROM nodes)""",
            "nodes",
        ),
        "graph_json": sql(
            f"""SELECT 'nodes' AS section, '{{"sensorId":"node' || (node - 1) || '","fixed":true,"group":1,"x":' ||
            (CAST(floor((node - 1) % CAST(floor(sqrt(n)) AS BIGINT) * {side}) AS BIGINT) + 20) || ',"y":' ||
            (CAST(floor((node - 1) // CAST(floor(sqrt(n)) AS BIGINT) * {side}) AS BIGINT) + 20) || '}}' AS json
            FROM nodes, (SELECT count(*) AS n FROM nodes)
            UNION ALL SELECT 'links', '{{"source":' || (src - 1) || ',"target":' || (dst - 1) || ',"value":1}}'
            FROM edges WHERE src < dst""",
            "nodes", "edges",
        ),
        "topology_check": sql(
            """SELECT 'duplicate_id' AS rule, node, count(*) AS n FROM all_nodes GROUP BY node HAVING count(*) > 1
            UNION ALL SELECT 'duplicate_neighbour', src, count(*) FROM (
              SELECT src, dst FROM faulty GROUP BY src, dst HAVING count(*) > 1) GROUP BY src
            UNION ALL SELECT 'degree', src, count(*) FROM faulty GROUP BY src HAVING count(*) > 4
            UNION ALL SELECT 'unknown_source', src, count(*) FROM faulty
              WHERE src NOT IN (SELECT node FROM nodes) GROUP BY src
            UNION ALL SELECT 'unknown_neighbour', dst, count(*) FROM faulty
              WHERE dst NOT IN (SELECT node FROM nodes) GROUP BY dst
            UNION ALL SELECT 'unknown_station_node', c_custkey, count(*) FROM customer
              WHERE c_custkey NOT IN (SELECT node FROM nodes) GROUP BY c_custkey""",
            "nodes", "edges",
            all_nodes="SELECT node FROM nodes UNION ALL SELECT DISTINCT (node - 1) % 5 + 1 FROM nodes",
            faulty="SELECT src, dst FROM edges UNION ALL SELECT node, node * 2 FROM nodes",
        ),
        "adjacency_edges": sql("SELECT src, dst FROM edges", "nodes", "edges"),
        "xml_topology": sql(
            """SELECT 'edge' AS kind, src AS a, dst AS b FROM edges
            UNION ALL SELECT 'station', (node - 1) % 5 + 1, node FROM nodes""",
            "nodes", "edges",
        ),
        "keyed_values": sql(
            """SELECT node, strftime(batch, '%Y%m%d') AS count, value FROM readings
            QUALIFY row_number() OVER (PARTITION BY batch, node ORDER BY ts DESC, event_id DESC) = 1""",
            "readings",
        ),
        "wide_values": """
            SELECT tick, unnest([1, 2, 3, 4]::BIGINT[]) AS node,
              unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value
            FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
              l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS tick FROM lineitem)""",
        "tuple_values": sql(
            f"SELECT strftime(batch, '%Y%m%d') AS count, node, {r6('value', 'value')} FROM obs", "readings", "obs"
        ),
        "tuple_sets": sql(
            f"SELECT batch, node, {listed} FROM sets", "readings", "obs", "nodes",
            **tried_sets("obs", ["batch", "node"], R_TEMPORAL, DRAWS_TEMPORAL),
        ),
        "write_batches": sql(lisa_rows, *BASE),
        "stream_observations": sql("SELECT event_id, batch, node, value FROM readings", "readings"),
        "stream_spatial_lisa": sql(lisa_rows, *BASE),
        "stream_window_lisa": sql(lisa_rows, *BASE),
        "stream_open_lisa": sql(lisa_rows, *BASE),
        "stream_open_lisa_multi": multi,
        "stream_window_lisa_multi": multi,
        "stream_history": f"""
            SELECT event_id, node, CAST(len(vals) AS INTEGER) AS n, {values} FROM (
              SELECT event_id, user_id + 1 AS node, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) AS vals FROM events)""",
        "stream_temporal_lisa": sql(
            f"SELECT batch, node, {r6('lisa', 'lisa')} FROM tlisa",
            "readings", "obs", "nodes", "edges", "hist", "cells", **tables["temporal"],
        ),
        "stream_lisa_mc": sql(f"SELECT {RANK_COLUMNS} FROM ranked", *BASE, **mc_temporal_r),
        "stream_word_count": sql(
            "SELECT CAST(0 AS BIGINT) AS batch, word, count(*) AS n FROM words GROUP BY word", words=word_rows
        ),
        "batch_metrics": "SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS num_input_rows FROM events",
        "expected_lisa": sql(f"SELECT batch, node, {r6('lisa', 'lisa')} FROM expected", *BASE, **degree_lisa),
        "expected_positions": sql(
            f"SELECT batch, node, {r6('(below + 1) / (n + 1)', 'position')} FROM ranked", *BASE, **mc_temporal_r
        ),
        "stored_positions": sql(
            f"SELECT batch, node, {r6('(below + 1) / (n + 1)', 'position')} FROM ranked", *BASE, **mc_temporal_r
        ),
        "compare_results": sql(
            """SELECT 'degree' AS check, count(*) AS bad FROM lisa l
            FULL JOIN expected x ON x.batch = l.batch AND x.node = l.node
            WHERE NOT coalesce(abs(l.lisa - x.lisa) <= 0.5 * 1e-6 * (abs(l.lisa) + abs(x.lisa)), false)
            UNION ALL SELECT 'shifted', count(*) FROM lisa WHERE node % 2 = 0""",
            *BASE, **degree_lisa,
        ),
        "parse_delays": f"SELECT {day_ms} AS batch, {r6('value', 'seconds')} FROM events",
        "batches_with_data": sql(
            "SELECT batch, CAST(sum(lines) AS BIGINT) AS n FROM files GROUP BY batch", "readings", files=files
        ),
        "run_durations": sql(
            f"""SELECT event_id, {day_ms} AS batch, value AS seconds FROM readings
            WHERE batch IN (SELECT batch FROM files)""",
            "readings", files=files,
        ),
        "duration_summary": sql(f"SELECT base, run, {summary} FROM durations GROUP BY base, run", "durations"),
        "duration_summary_combined": sql(f"SELECT base, {summary} FROM durations GROUP BY base", "durations"),
        "run_averages_wide": sql(
            "SELECT base, "
            + ", ".join(f"round(max(a) FILTER (i = {i}), 6) + 0.0 AS avg{i}" for i in range(1, len(RUNS) + 1))
            + """ FROM (SELECT base, avg(seconds) AS a, row_number() OVER (PARTITION BY base ORDER BY run) AS i
            FROM durations GROUP BY base, run) GROUP BY base""",
            "durations",
        ),
        "history_pivot": sql(
            "SELECT k, "
            + ", ".join(f"round(max(a) FILTER (base = {b}), 6) + 0.0 AS base_{b}" for b in (1, 2, 4, 8, 16))
            + f""", {r6('avg(a)', 'avg')} FROM (
            SELECT k, base, avg(seconds) AS a FROM durations GROUP BY k, base) GROUP BY k""",
            "durations",
        ),
        "topology_averages": sql(
            f"SELECT topology, {r6('avg(seconds)', 'avg')} FROM durations GROUP BY topology", "durations"
        ),
        "run_series_wide": sql(
            "SELECT idx, "
            + ", ".join(f"max(seconds) FILTER (run = '{run}') AS \"{run}\"" for run in RUNS)
            + """ FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY batch, event_id) AS idx
            FROM durations) GROUP BY idx""",
            "durations",
        ),
        "run_averages": sql(
            f"""SELECT base, row_number() OVER (PARTITION BY base ORDER BY run) AS no, {r6('a', 'avg')}
            FROM (SELECT base, run, avg(seconds) AS a FROM durations GROUP BY base, run)""",
            "durations",
        ),
        "history_averages": sql(f"SELECT k, base, {r6('avg(seconds)', 'avg')} FROM durations GROUP BY k, base", "durations"),
        "run_series": sql(
            "SELECT row_number() OVER (PARTITION BY run ORDER BY batch, event_id) AS idx, run, seconds FROM durations",
            "durations",
        ),
        "stream_temporal_mc_local": temporal_mc("local"),
        "stream_temporal_mc_global": temporal_mc("global"),
        "duration_by_k": sql("SELECT DISTINCT seconds, k FROM durations", "durations"),
    }

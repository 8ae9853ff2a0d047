"""XML topologies: ``<node nodeId>`` with neighbours, ``<basestation stationId>`` with nodes."""

from pyspark.sql import functions as F

from localstat import schemas
from localstat.functions.scalars import node_key


def read_topology_xml(spark, path):
    """Edges as listed (one row per neighbour entry) and the station of each node."""

    def rows(tag, schema):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    # A station's node references use the same tag as nodes but carry no id.
    nodes = rows("node", schemas.XML_NODE).where(F.col("_nodeId").isNotNull())
    edges = nodes.select(node_key("_nodeId").alias("src"), F.explode("neighbour").alias("_to")).select(
        "src", node_key("_to").alias("dst")
    )
    stations = (
        rows("basestation", schemas.XML_STATION)
        .select(node_key("_stationId").alias("station"), F.explode("node").alias("_of"))
        .select("station", node_key("_of").alias("node"))
    )
    return edges, stations

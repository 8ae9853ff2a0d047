"""Column layouts used across the package.

``batch`` may be any orderable type (a date, a window start, a micro-batch id);
every operator keeps it as a grouping key and never looks inside it.
"""

from pyspark.sql import types as T

EDGES = "src BIGINT, dst BIGINT"
STATIONS = "station BIGINT, node BIGINT"
OBSERVATIONS = "node BIGINT, value DOUBLE"
XML_NODE = "_nodeId STRING, neighbour ARRAY<STRING>"
XML_STATION = "_stationId STRING, node ARRAY<STRING>"

BATCH_METRICS = (
    "query STRING, batch_id BIGINT, submitted STRING, num_input_rows BIGINT, scheduling_delay_ms BIGINT, "
    "processing_start_ms BIGINT, processing_end_ms BIGINT, execution_ms BIGINT, total_delay_ms BIGINT"
)

METRICS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("submitted", T.StringType()),
        T.StructField("num_input_rows", T.LongType()),
        T.StructField("planning_ms", T.LongType()),
        T.StructField("execution_ms", T.LongType()),
        T.StructField("total_ms", T.LongType()),
    ]
)

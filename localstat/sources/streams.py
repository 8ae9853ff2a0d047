"""Streaming sources of readings."""


def stream_observations(spark, path, schema, fmt="parquet", max_files=None):
    """Readings that arrive as files; ``max_files`` bounds one micro-batch.

    ``path`` may be a folder or a glob. Several folders are united with ``unionByName``.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)

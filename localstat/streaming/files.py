"""Folders of state and results, by way of Hadoop's file systems."""


def drop_others(spark, path, stays):
    """Delete the entries of a folder whose name does not satisfy ``stays``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder):
        for entry in fs.listStatus(folder):
            if not stays(entry.getPath().getName()):
                fs.delete(entry.getPath(), True)

"""Python workers need this package; a session may have been started without it."""

import io
import zipfile
from pathlib import Path

import localstat
from localstat.plans.scale import shared_dir

_shipped = set()


def ship(spark):
    """Hand the package to the Python workers, once per application, by way of the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, data = Path(localstat.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    target = f"{shared_dir(spark)}/localstat.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(data.getvalue())
    out.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)

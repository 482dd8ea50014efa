"""Spark-native analytics for labelled transcription corpora."""

from __future__ import annotations

import os
import tempfile
import zipfile


#: Bytes of one Arrow batch to Python: rows here may be whole documents, and a batch stands in memory several times.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark) -> None:
    """Sends this package to the executors, once a context, so that Python workers find it wherever they run.

    A session that has no limit of its own for Arrow batches gets one.
    """
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_scrivana_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # not when the package itself was loaded from an archive that is shipped already
        path = os.path.join(tempfile.mkdtemp(prefix="scrivana-ship-"), "scrivana_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        at = os.path.join(folder, name)
                        out.write(at, os.path.join("scrivana", os.path.relpath(at, root)))
        context.addPyFile(path)
    context._scrivana_shipped = True

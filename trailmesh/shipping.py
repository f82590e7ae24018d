"""Make this package importable on the executors; the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="trailmesh-"), "trailmesh-source.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("trailmesh", os.path.relpath(full, top)))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a folder of our own, on a local master only: machines of a cluster
    don't see each other's folders.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trailmesh-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")

"""Brings this package to Python workers that do not have it installed."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

import klaxon

from ..session import shared_folder
from .archives import open_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source files to the application, once for each, by way of the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top, packed = os.path.dirname(os.path.abspath(klaxon.__file__)), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, files in os.walk(top):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    place = f"{shared_folder(spark)}/package-{uuid.uuid4().hex}"
    fs, folder = open_folder(place)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/klaxon.zip", compression=None) as sink:
        sink.write(packed.getvalue())
    context.addPyFile(f"{place}/klaxon.zip")
    _shipped.add(context.applicationId)

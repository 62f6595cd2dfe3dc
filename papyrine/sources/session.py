"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch handed to Python, so that whole texts stay bounded whatever their length.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; smaller bounds stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = re.fullmatch(r"(-?\d+)([bkm]?)b?", spark.conf.get(name).lower())
        size = int(own[1]) << {"": 0, "b": 0, "k": 10, "m": 20}[own[2]] if own and own[1][0] != "-" else 0
        if not 0 < size <= most:
            spark.conf.set(name, str(most))


def ship_package(spark: SparkSession) -> None:
    """Bound batches, and send this package to the session's Python workers, once; the driver serves the file itself."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_papyrine_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="papyrine-")) / "papyrine.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, Path(package.name) / file.relative_to(package))
    context.addPyFile(str(target))
    context._papyrine_sent = True

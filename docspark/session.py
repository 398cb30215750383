"""Makes the package importable on executors, wherever the driver runs from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Rows and bytes of a batch that Python gets: whole texts, of which a few may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    spark.checkpoint.dir. Only on a single machine, where that may be unset, a folder of
    our own is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="docspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, and bounds the size
    of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="docspark-")) / "docspark_package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f"{home.name}/{f.relative_to(home)}")
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark

"""Session settings the jobs rely on."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Rows may hold a whole file (2 MiB), so Arrow batches are kept short.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "200",
}


def local_session(cpus: int | str = 8, app: str = "codelake", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Small shuffles are still worth all cores of one machine.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder every executor sees: the one the cluster names, or in local mode one made here."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="codelake-")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Batches sent to workers are bounded by bytes as well, unless the session already says how.
    """
    context = spark.sparkContext
    if spark.conf.get(ARROW_BYTES, "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set(ARROW_BYTES, "16m")
    if any(f.endswith("/codelake.zip") for f in context.listFiles):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="codelake-code-")) / "codelake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))

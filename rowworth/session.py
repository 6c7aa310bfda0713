"""Session set-up and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


# applications that have the package
_SHIPPED: set[str] = set()


def build_session(app: str = "rowworth", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it inside Arrow functions."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="rowworth-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    archive = Path(folder) / "rowworth.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session gets a scratch one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        scratch = tempfile.mkdtemp(prefix="rowworth-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        context.setCheckpointDir(scratch)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder: later steps reread it instead of recomputing it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, for written intermediate tables."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after measuring `df`; beyond the bound the optimizer picks the join."""
    return F.broadcast(df) if fits(df, max_bytes) else df


def fits(df: DataFrame, max_bytes: int = 64 << 20) -> bool:
    """Whether the measured size of `df` is within the bound."""
    width = F.lit(0)
    for field in df.schema.fields:
        if field.dataType.typeName() in ("string", "binary"):
            size = F.octet_length(field.name)
        elif field.dataType.typeName() == "array" and isinstance(field.dataType.elementType, NumericType):
            size = F.size(field.name) * 8
        elif field.dataType.typeName() in ("array", "struct", "map"):
            # names, digits and quotes take about as much as the fields and their offsets
            size = F.octet_length(F.to_json(F.struct(field.name)))
        else:
            size = F.lit(0)
        width = width + F.coalesce(size, F.lit(0)) + 16
    total = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return total <= max_bytes

"""Session settings, audit thresholds and run configuration."""

from __future__ import annotations

import os
import tempfile
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

# Rows one task may hold for one group before ordered work on it is split.
GROUP_ROWS_CONF = "spark.wanderloop.groupRows"
DEFAULT_GROUP_ROWS = 4_000_000

_shipped: set[str] = set()


@dataclass(frozen=True)
class Thresholds:
    """Decision constants of the permutation record (fixed values)."""

    alpha: float = 0.05
    delta_min: float = 1e-3
    lobs_mult: float = 5.0
    eps: float = 1e-12
    eps_sig: float = 1e-6
    mad_scale: float = 1.4826
    null_collapse_zero_frac: float = 0.7
    null_collapse_lobs_min: float = 0.05


@dataclass(frozen=True)
class AuditConfig:
    """One audit run: graph growth, filtration, null ensemble and seeds.

    ``filtration_pct=None`` runs the filtration to the largest distance; a
    number cuts it at that percentile, even when the number is 95.
    """

    seed: int = 42
    n_nulls: int = 200
    block_sizes: tuple[int, ...] = (1,)
    k0: int = 12
    kmax: int = 199
    filtration_pct: float | None = None
    sentinel_fill: bool = False
    max_points: int = 2000  # checkpoints whose distance matrix one task holds
    seed_by_key: bool = False  # nulls of its own for every trajectory, from a hash of its key
    thin_long: bool = False  # audit longer trajectories at max_points kept checkpoints
    whole_long: bool = False  # audit longer trajectories whole, by matrices that lie in files
    chunk_cols: int = 50_000
    nulls_per_task: int = 25
    thresholds: Thresholds = field(default_factory=Thresholds)


def build_session(app: str = "wanderloop", master: str | None = None) -> SparkSession:
    """A session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # One BLAS thread per Python worker: the tasks are the parallelism.
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="wanderloop-")) / "wanderloop.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def run_seed(arch_index: int, optimizer_index: int, offset: int, base: int = 42) -> int:
    """Seed of one run of a sweep."""
    return base + 10_000 * arch_index + 100 * optimizer_index + offset


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wanderloop-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def bound_arrow_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Keep Arrow batches of wide rows small; only lowers the session's limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    raw = spark.conf.get(key).rstrip("bB")
    now = int(raw) if raw.lstrip("-").isdigit() else 0
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def env_flag(name: str, default: bool = False) -> bool:
    """Boolean switch from the environment."""
    raw = os.environ.get(name)
    return default if raw is None else raw.strip().lower() in {"1", "true", "yes", "y"}

"""Session set-up and the few cluster-facing helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings act_archive retrospective_store "
    "state_observations verified_reconstruction_reviews procedure_watch_state procedure_watch_history decisions "
    "amendment_fates subject_labels subject_areas watch_sources"
).split()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def local_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of whole numbers from the driver; as an Arrow table it is part of the plan and needs no job."""
    import pyarrow as pa

    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, a single Parquet file or a folder of them."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new name in the cluster's shared folder (``spark.checkpoint.dir``); a session without one gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return os.path.join(base or tempfile.mkdtemp(prefix="palimpsest-"), f"{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only a session without one (tests, a laptop) gets a
    temporary folder. The copy is reliable: it survives the loss of any executor, unlike ``localCheckpoint``.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="palimpsest-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

"""Cutting lineage: reliable checkpoints and kept tables.

They write to the shared folder named by ``spark.checkpoint.dir`` and give a
frame whose plan is a leaf, so iterative jobs keep short plans and a lost
executor replays at most one step. Never a machine-local folder, never
``localCheckpoint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint()`` whose write pass reads a cache, not a recompute.

    The result is a plan leaf (its files live in the shared checkpoint
    folder), so iterating on it never grows the plan; the cache is released
    once the files are written.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet under the shared checkpoint folder and read back.

    For a frame that several jobs read: each reads the columns it needs, none
    derives them again, and no executor holds them in its cache.
    """
    from ..session import scratch_dir
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """:func:`cut` whose checkpoint is written by the job that counts the rows
    matching ``condition`` (one computation for both)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=False)
    n = out.filter(condition).count()   # computes into the cache, then writes the checkpoint from it
    cached.unpersist()
    return out, n

"""Control rules of a staged run: which step is next, which checkpoints are read, whether a reading may be used."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import schedule_step
from ..sources.versioned import get, put


def next_step(done: dict[str, bool], hold: str | None = None) -> tuple[str | None, int]:
    """The first step without its artefact; exit 0 all done, 10 run it, 20 held by name."""
    step, code = schedule_step(done)
    return (step, 20) if step is not None and hold == step else (step, code)


def hold_of(spark: SparkSession, folder: str) -> str | None:
    """C4: the step that the file ``HOLD`` of a folder names, null without one."""
    found = get(spark, f"{folder}/HOLD")
    return found.strip() or None if found else None


def smoke_cache(spark: SparkSession, folder: str) -> dict[str, bool]:
    """C4: which commits passed a smoke test, of the file ``smoke.json``; a torn or absent one counts as empty."""
    try:
        told = json.loads(get(spark, f"{folder}/smoke.json") or "{}")
    except json.JSONDecodeError:
        return {}
    return {k: v is True for k, v in told.items()} if isinstance(told, dict) else {}


def smoke_told(spark: SparkSession, folder: str, commit: str, passed: bool) -> None:
    """C4: notes the outcome of a commit's smoke test; the file is swapped whole."""
    put(spark, f"{folder}/smoke.json", json.dumps(smoke_cache(spark, folder) | {commit: passed}))


def smoke_passed(cache: dict[str, bool], commit: str, dirty: bool) -> bool:
    """C4: a smoke test counts for the clean commit that it ran on."""
    return not dirty and cache.get(commit, False)


def chosen(ckpts: DataFrame, every: bool = False, tokens: list[int] | None = None) -> DataFrame:
    """All checkpoints, the listed ones (each must exist), or the final one; never a mix."""
    if every and tokens:
        raise ValueError("ask for all checkpoints or for a list, not both")
    if every:
        return ckpts
    if tokens is None:
        return ckpts.join(F.broadcast(ckpts.agg(F.max("tokens").alias("tokens"))), "tokens", "left_semi")  # one row
    found = ckpts.filter(F.col("tokens").isin(tokens))
    if found.select("tokens").distinct().count() != len(set(tokens)):
        raise ValueError("a listed checkpoint does not exist")
    return found


def after_divergence(rate: float, halved: bool) -> tuple[float | None, int]:
    """The rate of the fresh run and the exit code: one halving is allowed, a second divergence is a hard failure."""
    return (None, 20) if halved else (rate / 2, 0)


def may_escalate(copy_low: float, chance: float) -> bool:
    """Only after copying clears chance, strictly."""
    return copy_low > chance


def stamped(rows: DataFrame, n_sequences: int, registered: int, allow: bool = False) -> DataFrame:
    """Readings with whether they are at the registered number of sequences; fewer are refused unless allowed."""
    at = n_sequences == registered
    if not at and not allow:
        raise ValueError("a monitoring reading is not a registered one")
    return rows.withColumn("at_registered_n_sequences", F.lit(at))


def shape_checked(rows: DataFrame, array: str, size: int) -> DataFrame:
    """Arrays of one length only."""
    return rows.filter(F.when(F.size(array) == size, True).otherwise(F.raise_error(F.lit("an array has another length")).cast("boolean")))

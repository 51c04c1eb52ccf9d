"""A run of named steps: each reads tables of earlier steps and writes its own."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("curvestat")


@dataclass
class Step:
    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    inputs: tuple[str, ...] = field(default=())
    #: Parameters that build is called with, and paths of files that it reads; both are part of the step's fingerprint.
    params: dict = field(default_factory=dict)
    sources: tuple[str, ...] = field(default=())


def plan(steps: list[Step]) -> list[str]:
    """The steps in order with their inputs; fails on unknown inputs and repeated names."""
    known, lines = set(), []
    for s in steps:
        missing = [i for i in s.inputs if i not in known]
        if missing or s.name in known:
            raise ValueError(f"step {s.name}: " + (f"unknown inputs {missing}" if missing else "repeated name"))
        known.add(s.name)
        lines.append(f"{s.name} <- {', '.join(s.inputs) or 'sources'}")
    return lines


def run(spark: SparkSession, steps: list[Step], folder: str) -> dict[str, DataFrame]:
    """Run steps in order, each result written as Parquet and read again; the first failure ends the run."""
    plan(steps)
    done: dict[str, DataFrame] = {}
    for s in steps:
        LOG.info("START %s", s.name)
        began = time.monotonic()
        s.build(spark, {i: done[i] for i in s.inputs}, **s.params).write.mode("overwrite").parquet(f"{folder}/{s.name}")
        done[s.name] = spark.read.parquet(f"{folder}/{s.name}")
        LOG.info("END %s after %.1f s", s.name, time.monotonic() - began)
    return done


def _files(spark: SparkSession, path: str) -> list:
    """Number of the files below a path and a digest of their names, sizes and times that doesn't depend on their order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return list(files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime")))).first())


def fingerprints(spark: SparkSession, steps: list[Step]) -> dict[str, str]:
    """A digest of each step's name, parameters, source files and inputs' fingerprints."""
    plan(steps)
    out: dict[str, str] = {}
    for s in steps:
        said = [s.name, s.params, [_files(spark, p) for p in s.sources], [out[i] for i in s.inputs]]
        out[s.name] = hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _place(folder: str, name: str, fingerprint: str) -> str:
    return f"{folder}/{name}-{fingerprint[:16]}"


def pending(spark: SparkSession, steps: list[Step], folder: str) -> list[str]:
    """The steps that resume would run, without running any."""
    marks = fingerprints(spark, steps)
    return [s.name for s in steps if not _exists(spark, f"{_place(folder, s.name, marks[s.name])}/_SUCCESS")]


def resume(spark: SparkSession, steps: list[Step], folder: str) -> dict[str, DataFrame]:
    """As run, but a step whose result of the same fingerprint is complete is read instead of run again.

    Results lie under the fingerprint, so a changed parameter or source makes the step and what depends on it run, and nothing
    else; earlier results stay. The first failure ends the run and is recorded in ``_failed``; a later run that gets
    past the step goes on from there.
    """
    marks, done = fingerprints(spark, steps), {}
    for s in steps:
        place = _place(folder, s.name, marks[s.name])
        if _exists(spark, f"{place}/_SUCCESS"):
            LOG.info("SKIP %s", s.name)
        else:
            LOG.info("START %s", s.name)
            try:
                s.build(spark, {i: done[i] for i in s.inputs}, **s.params).write.mode("overwrite").parquet(place)
            except Exception as error:
                row = spark.range(1).select(F.lit(s.name).alias("step"), F.lit(marks[s.name]).alias("fingerprint"), F.lit(f"{type(error).__name__}: {error}"[:2000]).alias("error"), F.current_timestamp().alias("at"))
                row.write.mode("append").json(f"{folder}/_failed")
                raise
            LOG.info("END %s", s.name)
        done[s.name] = spark.read.parquet(place)
    return done

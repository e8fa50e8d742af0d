"""Entry points for jobs: phases that run one after another and say how they ended, and timings of variants.

``python -m windgrid.jobs --tables DIR --out DIR query ...`` runs registered queries as phases.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Phase:
    name: str
    state: str  # done, failed or skipped
    rows: int
    seconds: float
    detail: str = ""


def run_phases(phases: list[tuple[str, Callable[[], DataFrame]]], write: Callable[[str, DataFrame], int], say: Callable[[str], None] = lambda line: None) -> list[Phase]:
    """Runs phases in order; `write` stores a phase's result and returns its rows. After a failure the others are skipped.

    say: gets a JSON line when a phase begins and when it ends.
    """
    out: list[Phase] = []
    for name, plan in phases:
        if any(p.state == "failed" for p in out):
            out.append(Phase(name, "skipped", 0, 0.0))
            continue
        say(json.dumps({"name": name, "state": "running"}))
        began = time.monotonic()
        try:
            phase = Phase(name, "done", write(name, plan()), round(time.monotonic() - began, 3))
        except Exception as e:  # noqa: BLE001  a phase's failure is its result
            phase = Phase(name, "failed", 0, round(time.monotonic() - began, 3), f"{type(e).__name__}: {e}"[:500])
        out.append(phase)
        say(json.dumps(asdict(phase)))
    return out


def to_parquet(spark: SparkSession, folder: str) -> Callable[[str, DataFrame], int]:
    """Stores a result below folder and counts what was written."""

    def write(name: str, df: DataFrame) -> int:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path).count()

    return write


def compare_profiles(spark: SparkSession, plan: Callable[[], DataFrame], profiles: dict[str, dict[str, str]], base: str, frames: int, repeats: int = 2) -> list[dict]:
    """Times a plan under session settings: profile, rows, checksum, seconds, seconds_per_frame, and the share of the base's time.

    The least of `repeats` runs counts, as the first also compiles. Settings are put back. Results must agree: the
    checksum is a sum of row hashes.
    """
    from pyspark.sql import functions as F

    found = []
    for name, settings in profiles.items():
        before = {k: spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            times = []
            for _ in range(repeats):
                df = plan()
                began = time.monotonic()
                row = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns) % 1_000_003).alias("checksum")).first()
                times.append(time.monotonic() - began)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        found.append({"profile": name, "rows": row["rows"], "checksum": row["checksum"], "seconds": min(times), "seconds_per_frame": min(times) / max(1, frames)})
    of_base = next(f["seconds"] for f in found if f["profile"] == base)
    return [f | {"share_of_base": f["seconds"] / of_base} for f in found]


def main(arguments: list[str] | None = None) -> int:
    from windgrid.plans.queries import QUERIES

    a = argparse.ArgumentParser(description="Runs queries as phases of a job")
    a.add_argument("--tables", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("query", nargs="+")
    given = a.parse_args(arguments)
    if unknown := [q for q in given.query if q not in QUERIES]:
        a.error(f"no such query: {', '.join(unknown)}")
    spark = SparkSession.builder.getOrCreate()
    done = run_phases([(q, lambda q=q: QUERIES[q](spark, given.tables)) for q in given.query], to_parquet(spark, given.out), print)
    return int(any(p.state != "done" for p in done))


if __name__ == "__main__":
    raise SystemExit(main())

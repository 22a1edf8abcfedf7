"""Steps with named prerequisites, whose results are kept by fingerprint, so that a rerun makes what changed only."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.published import unit_hashes


@dataclass(frozen=True)
class Step:
    """A table made from others: `make` takes the tables that `needs` names, in order, and `params` by name.

    `version` is raised by hand when `make` changes what it does. Params must be JSON values.
    """

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    params: dict[str, Any] = field(default_factory=dict)
    version: int = 1


@dataclass(frozen=True)
class Made:
    """Tables by name; the steps that were made, in order; and those whose results were there."""

    tables: dict[str, DataFrame]
    made: tuple[str, ...]
    kept: tuple[str, ...]


def content_fingerprint(df: DataFrame) -> str:
    """A hash of a table's columns and rows, in any order; repeated rows count."""
    found = unit_hashes(df.withColumn("__all", F.lit(0)), ["__all"]).collect()  # one row, or none
    return hashlib.sha256(json.dumps([json.loads(df.schema.json()), found[0]["hash"] if found else "empty"]).encode()).hexdigest()


class Steps:
    """A set of steps. Names must be unique; a step may need other steps, and tables that the caller gives."""

    def __init__(self, *steps: Step):
        self.steps = {s.name: s for s in steps}
        if len(self.steps) < len(steps):
            raise ValueError("two steps have one name")

    def order(self, wanted: list[str], given: set[str]) -> list[str]:
        """The steps that `wanted` rests on, each after its prerequisites. A circle and a prerequisite that nothing makes are errors that name the step."""
        out: list[str] = []
        entered: set[str] = set()
        todo = [(name, "", False) for name in reversed(wanted)]
        while todo:
            name, by, ready = todo.pop()
            if ready:
                entered.discard(name)
                out.append(name)
            elif name in entered:
                raise ValueError(f"step {name} rests on itself")
            elif name not in given and name not in out:
                if name not in self.steps:
                    raise ValueError(f"step {by} needs {name}, which no step makes and nobody gave" if by else f"no step makes {name}")
                entered.add(name)
                todo.append((name, by, True))
                todo += [(n, name, False) for n in reversed(self.steps[name].needs)]
        return out

    def fingerprints(self, order: list[str], given: dict[str, str]) -> dict[str, str]:
        """A hash of each step's name, version, params and the fingerprints of what it needs."""
        known = dict(given)
        for name in order:
            s = self.steps[name]
            told = [name, s.version, s.params, [known[n] for n in s.needs]]
            known[name] = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
        return known

    def run(self, spark: SparkSession, folder: str, given: dict[str, DataFrame], wanted: list[str], known: dict[str, str] | None = None) -> Made:
        """Make the tables `wanted` and what they rest on, in a shared folder; results that are there by their fingerprint are read.

        known: fingerprints of given tables that the caller has already, such as the names of their snapshots; others are
        found from the content. A result counts as there when its write ended; one that was cut off is made anew.
        """
        order = self.order(wanted, set(given))
        needed = {n for name in order for n in self.steps[name].needs} & set(given)
        prints = self.fingerprints(order, {n: (known or {}).get(n) or content_fingerprint(given[n]) for n in sorted(needed)})
        tables, made, kept = dict(given), [], []
        for name in order:
            path = f"{folder}/{name}-{prints[name]}.parquet"
            if _ended(spark, path):
                kept.append(name)
            else:
                s = self.steps[name]
                s.make(*[tables[n] for n in s.needs], **s.params).write.mode("overwrite").parquet(path)
                made.append(name)
            tables[name] = spark.read.parquet(path)
        return Made({n: tables[n] for n in wanted}, tuple(made), tuple(kept))


def _ended(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)

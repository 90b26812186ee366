"""Feature expressions of sets of systems: from a table, a truth table, or an external program."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "systems_key string, expr string"


def from_program(keys: DataFrame, program: str, spec: str) -> DataFrame:
    """(systems_key, expr) for the distinct keys, one call ``<program> expr <spec> <ids>`` each; no output is an empty expression.

    A program that ends with an error ends the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [subprocess.run([program, "expr", spec, f"{k} "], capture_output=True, text=True, check=True).stdout.rstrip() for k in batch["systems_key"]]
            yield batch.assign(expr=said)

    return keys.select("systems_key").distinct().mapInPandas(run, SCHEMA)


def minterms(systems: dict[str, tuple[bool, ...]], features: list[str], present: list[str]) -> str:
    """The shortest conjunction of literals that all ``present`` systems satisfy and no other does, else a disjunction of full ones."""
    rows = [systems[s] for s in present]
    fixed = [(k, rows[0][k]) for k in range(len(features)) if len({r[k] for r in rows}) == 1] if rows else []
    covered = {s for s, v in systems.items() if all(v[k] == x for k, x in fixed)}
    if covered == set(present):
        return " ∧ ".join(("" if x else "¬") + features[k] for k, x in fixed)
    return " ∨ ".join(" ∧ ".join(("" if x else "¬") + f for f, x in zip(features, systems[s], strict=True)) for s in present)

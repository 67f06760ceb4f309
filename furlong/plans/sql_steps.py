"""Transform steps kept as SQL text.

A step is a file of statements, each ended by a semicolon at a line's end.
Steps run in the order of their file names, or a chosen subset in the order
asked for. Statements take named parameters (``:as_of``) and build table names
from them (``IDENTIFIER(:prefix || '_core.x')``); Spark binds the values, so
no text is pasted into a statement. A name that is unknown, a folder without
steps and a parameter without value are errors before anything runs.
"""

from __future__ import annotations

import logging
import os
import re
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from furlong.plans.runner import UnknownStep

log = logging.getLogger(__name__)

STEPS_DIR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "steps")
_PARAMETER = re.compile(r"(?<![:\w]):([A-Za-z_]\w*)")


def resolve_files(folder: str = STEPS_DIR, only: str | list[str] | None = None) -> list[Path]:
    """The step files to run; a name may lack its ``.sql``."""
    have = {p.name: p for p in sorted(Path(folder).glob("*.sql"))}
    if not only:
        if not have:
            raise UnknownStep(f"no step in {folder}")
        return list(have.values())
    asked = [x for x in map(str.strip, only.split(",") if isinstance(only, str) else only) if x]
    names = [x if x.endswith(".sql") else f"{x}.sql" for x in asked]
    lacking = [x for x in names if x not in have]
    if lacking or not names:
        raise UnknownStep(f"no such step: {', '.join(lacking)}" if lacking else "no step was named")
    return [have[x] for x in names]


def statements(text: str) -> list[str]:
    """Statements of a step, without comment lines."""
    lines = [x for x in text.splitlines() if not x.lstrip().startswith("--")]
    return [s for s in (x.strip() for x in re.split(r";[ \t]*(?:\n|$)", "\n".join(lines))) if s]


def run_files(spark: SparkSession, folder: str = STEPS_DIR, only: str | list[str] | None = None,
              plans: Mapping[str, DataFrame] | None = None, **params) -> list[str]:
    """Run steps; returns the names that ran. ``plans`` are DataFrame plans
    that the text may read as ``plan_<name>``."""
    todo = [(p.name, statements(p.read_text(encoding="utf-8"))) for p in resolve_files(folder, only)]
    lacking = sorted({x for _, text in todo for s in text for x in _PARAMETER.findall(s)} - set(params))
    if lacking:
        raise ValueError(f"no value for {', '.join(lacking)}")
    for name, plan in (plans or {}).items():
        plan.createOrReplaceTempView(f"plan_{name}")
    for name, text in todo:
        log.info("step %s", name)
        for s in text:
            spark.sql(s, args={x: params[x] for x in _PARAMETER.findall(s)})
    return [name for name, _ in todo]


def layer_params(base: str, prefix: str, as_of: str, run: str | None = None) -> dict[str, str]:
    """Parameters of the steps in ``STEPS_DIR``; ``run`` names this run's tables."""
    return {"prefix": prefix, "as_of": as_of, "run": run or uuid.uuid4().hex[:12],
            **{f"{x}_dir": f"{base}/_sql/{x}" for x in ("raw", "core", "serving", "ml")}}

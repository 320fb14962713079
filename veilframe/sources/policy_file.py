"""Policies kept in files, on any file system that Spark reads."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from veilframe.operators.policy import GovernancePolicy

log = logging.getLogger(__name__)


def _yaml(text: str) -> Any:
    import yaml  # optional dependency: JSON policies do without

    return yaml.safe_load(text)


#: How the text of a file becomes values, by what its name ends in.
PARSERS: dict[str, Callable[[str], Any]] = {"json": json.loads, "yaml": _yaml, "yml": _yaml}


def policy_text(spark: SparkSession, path: str) -> str:
    """The file's text, read by Spark, so ``s3a://`` or ``hdfs://`` paths work as local ones do."""
    try:
        row = spark.read.text(str(path), wholetext=True).first()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        raise FileNotFoundError(f"there is no policy at {path}") from None
    return row["value"] if row else ""


def load_policy_mapping(spark: SparkSession, path: str) -> Mapping[str, Any]:
    """The parsed file; its ending picks the parser, and the top level must be a mapping."""
    parser = PARSERS.get(str(path).rpartition(".")[2].lower())
    if parser is None:
        raise ValueError(f"{path}: the name must end in one of {', '.join(sorted(PARSERS))}")
    values = parser(policy_text(spark, path))
    if isinstance(values, Mapping):
        return values
    raise ValueError(f"{path}: expected named settings at the top level, found {type(values).__name__}")


def load_policy(spark: SparkSession, path: str) -> GovernancePolicy:
    return GovernancePolicy.from_mapping(load_policy_mapping(spark, path))


def load_policy_or_default(spark: SparkSession, path: str) -> GovernancePolicy:
    """The policy at ``path``; where nothing lies there, the default one, with a warning."""
    try:
        return load_policy(spark, path)
    except FileNotFoundError as problem:
        log.warning("%s; the default policy holds", problem)
        return GovernancePolicy()

"""Deployments: a folder with a manifest, metadata and perhaps a policy of its own, and tables scoped to what it declares."""

from __future__ import annotations

import json
import types
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tarnwell.plans.model import Catalog, Frame, Policy
from tarnwell.sources.metadata import Metadata, load
from tarnwell.sources.tables import jdbc_table

MODES = ("sql", "embedding")


@dataclass
class Deployment:
    name: str
    mode: str
    metadata: Metadata | None
    policy: Policy
    settings: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def answers(self, method: str) -> bool:
        """Whether the policy overrides a hook."""
        return getattr(type(self.policy), method) is not getattr(Policy, method)


def _text(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return row[0] if row else None


def policy_of(source: str | None, name: str = "policy") -> tuple[Policy, list[str]]:
    """The first policy that a module's text defines, and warnings; the plain one if there is no text or it doesn't run."""
    if source is None:
        return Policy(), []
    module = types.ModuleType(f"deployment_{name}")
    try:
        exec(compile(source, f"{name}/policy.py", "exec"), module.__dict__)  # noqa: S102  a deployment's own code, as it was installed
    except Exception as e:  # noqa: BLE001  whatever a deployment's code raises
        return Policy(), [f"policy.py of {name} was left out: {e}"]
    own = [x for x in vars(module).values() if isinstance(x, type) and issubclass(x, Policy) and x is not Policy and x.__module__ == module.__name__]
    return (own[0]() if own else Policy()), []


def deployment(spark: SparkSession, folder: str, check: bool = True) -> Deployment:
    """A deployment from its folder: manifest.json (name, mode, config_dir and further settings), metadata and policy.py.

    Everything is read by Spark, so the folder may lie in any store.  Without a manifest there is no deployment; an unknown
    mode is an error; a policy that doesn't run is left out with a warning.  Only the mode `sql` needs metadata.
    """
    text = _text(spark, f"{folder}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"{folder} has no manifest.json")
    settings = json.loads(text)
    name, mode = settings.get("name") or folder.rstrip("/").rsplit("/", 1)[-1], str(settings.get("mode", "sql")).lower()
    if mode not in MODES:
        raise ValueError(f"deployment {name}: no mode {mode}")
    policy, warnings = policy_of(_text(spark, f"{folder}/policy.py"), name)
    metadata = load(spark, f"{folder}/{settings.get('config_dir', 'config/metadata')}", policy, check) if mode == "sql" else None
    return Deployment(name, mode, metadata, policy, settings, warnings)


def scoped_frames(spark: SparkSession, catalog: Catalog, source: str | Callable[[str], DataFrame], names: list[str] | None = None) -> tuple[dict[str, Frame], list[str]]:
    """The declared tables that a source has, and the names of those that it hasn't; if it has none of them, all that it has.

    source: a database of the session's catalog, a jdbc: URL, or what gives a table by its name and raises AnalysisException
    where there is none.  Nothing else of the source is looked at, unless no declared table is found; a function then needs
    the names of the source's tables.
    """
    if callable(source):
        read = source
    elif source.startswith("jdbc:"):
        read = lambda name: jdbc_table(spark, source, name)
    else:
        read = lambda name: spark.table(f"`{source}`.`{name}`")
        names = [t.name for t in spark.catalog.listTables(source)] if names is None else names
    found, missing = {}, []
    for name in catalog.tables:
        try:
            found[name] = read(name)
        except AnalysisException:
            missing.append(name)
    if not found:
        found = {n: read(n) for n in names or []}
    return found, missing

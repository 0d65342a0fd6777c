"""Configurations of the document analysis: registered, inherited, merged, checked, and applied to nodes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.json_chunks import called
from tarnwell.functions.json_parts import config_hits
from tarnwell.functions.json_words import DOMAINS, METRIC_PATTERNS

#: A configuration's own sections, and how many domains it had better not exceed.
SECTIONS, MOST_DOMAINS = ("domain_patterns", "metric_patterns"), 20
#: The configuration that is always there.
DEFAULT = {"description": "the built-in words", "domain_patterns": {d: list(words) for d, words in DOMAINS.items()}, "metric_patterns": dict(METRIC_PATTERNS)}


def merged(first: dict, *others: dict) -> dict:
    """One configuration of several: sections are merged entry by entry, lists are put behind one another, and of other
    values the last one counts.  Inheritance is resolved before, so `extends` is left out."""
    out = {k: v for k, v in first.items() if k != "extends"}
    for other in others:
        for key, value in other.items():
            if key == "extends":
                continue
            own = out.get(key)
            both = type(own) is type(value)
            out[key] = merged(own, value) if both and isinstance(value, dict) else [*own, *value] if both and isinstance(value, list) else value
    return out


@dataclass
class Problems:
    """What is wrong with a configuration, what is odd, and what would be better."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.errors


def checked(config: dict) -> Problems:
    """The problems of a configuration."""
    out = Problems()
    domains = config.get("domain_patterns")
    if domains is None:
        out.warnings.append("no section domain_patterns")
    elif not isinstance(domains, dict):
        out.errors.append("domain_patterns has to hold a list of words for each domain")
    else:
        out.errors += [f"domain {d} has no list of words" for d, words in domains.items() if not isinstance(words, list)]
        out.warnings += [f"domain {d} has no words" for d, words in domains.items() if words == []]
        out.suggestions += ["split it into several configurations"] * (len(domains) > MOST_DOMAINS)
    if not isinstance(config.get("metric_patterns", {}), dict):
        out.errors.append("metric_patterns has to hold a pattern for each kind of metric")
    out.suggestions += ["say in `description` what it is for"] * ("description" not in config)
    return out


class Configurations:
    """Configurations by name.  Files are read by Spark, so they lie wherever its tables do."""

    def __init__(self):
        self.known: dict[str, dict] = {"default": DEFAULT}

    def put(self, name: str, config: dict) -> dict:
        """Register a configuration; one with errors is refused."""
        if (found := checked(config)).errors:
            raise ValueError(f"configuration {name}: {'; '.join(found.errors)}")
        self.known[name] = config
        return config

    def get(self, name: str) -> dict:
        if name not in self.known:
            raise KeyError(f"no configuration {name}; there are {', '.join(sorted(self.known))}")
        return json.loads(json.dumps(self.known[name]))

    def merge(self, *names: str, into: str | None = None) -> dict:
        """Several configurations as one, with their names in merged_from; registered if a name is given."""
        if not names:
            raise ValueError("name a configuration")
        out = merged(*map(self.get, names)) | {"merged_from": list(names)}
        return self.put(into, out) if into else out

    def read(self, spark: SparkSession, path: str, seen: tuple[str, ...] = ()) -> dict:
        """A file's configuration on top of the one that it extends: a file beside it, or a registered name."""
        if path in seen:
            raise ValueError(f"{path} extends itself")
        try:
            text = spark.read.text(path, wholetext=True).first()
        except AnalysisException as e:
            raise FileNotFoundError(f"no configuration file {path}") from e
        config = json.loads(text[0])
        if not isinstance(config, dict):
            raise ValueError(f"{path} holds no configuration")
        if parent := config.get("extends"):
            above = self.get(parent) if parent in self.known else self.read(spark, f"{path.rsplit('/', 1)[0]}/{parent}", (*seen, path))
            config = merged(above, config)
        return config

    def take_in(self, spark: SparkSession, folder: str, prefix: str = "") -> tuple[list[str], dict[str, str]]:
        """Register every JSON file of a folder under its name; the names, and what was wrong with the files that were left out."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path").collect()  # a row for each configuration
        names, wrong = [], {}
        for path in sorted(r["path"] for r in files):
            name = prefix + path.rsplit("/", 1)[1].removesuffix(".json")
            try:
                self.put(name, self.read(spark, path))
                names.append(name)
            except (ValueError, KeyError, FileNotFoundError) as e:
                wrong[name] = str(e)
        return names, wrong

    def forget(self, *names: str) -> None:
        """Remove configurations, or all but the built-in one."""
        for name in names or [n for n in self.known if n != "default"]:
            self.known.pop(name, None)


def domains_by_config(nodes: DataFrame, config: dict) -> DataFrame:
    """document_id, domain, hits, domains and metrics of each document by a configuration's own words.

    hits of a domain: the nodes whose key or text holds one of its words, in any case of letters; domain is the one with most
    (of several the first of the configuration; `general` without any), domains all with a hit, metrics the kinds of metric
    whose pattern a key matches.  nodes may be documents (document_id, doc), too; these are counted within their rows.
    """
    words = {d: [w.lower() for w in ws] for d, ws in config.get("domain_patterns", {}).items()}
    patterns = config.get("metric_patterns", {})
    if "doc" in nodes.columns:
        found = called(nodes, config_hits, domains=list(words.values()))
        matched = lambda p: F.exists("keys", lambda x: F.lower(x).rlike(p))
        kinds = [matched(p).alias(f"m{k}") for k, p in enumerate(patterns.values())]
        out = found.select("document_id", *[F.col("hits")[k].alias(f"d{k}") for k in range(len(words))], *kinds)
    else:
        key, text = F.lower(F.coalesce("key", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
        holds = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(key, w) | F.contains(text, w)) if ws else F.lit(False)
        hits = [F.count(F.when(holds(ws), 1)).alias(f"d{k}") for k, ws in enumerate(words.values())]
        kinds = [F.coalesce(F.max(F.coalesce(F.lower("key").rlike(p), F.lit(False))), F.lit(False)).alias(f"m{k}") for k, p in enumerate(patterns.values())]
        out = nodes.groupBy("document_id").agg(F.count("*").alias("nodes"), *hits, *kinds)
    ranked = [F.struct(F.col(f"d{k}").alias("hits"), F.lit(-k).alias("place"), F.lit(d).alias("domain")) for k, d in enumerate(words)]
    best = F.array_max(F.array(*ranked)) if ranked else F.struct(F.lit(0).cast("long").alias("hits"), F.lit(0).alias("place"), F.lit("general").alias("domain"))
    none = F.array().cast("array<string>")
    some = lambda mark, names: F.array_compact(F.array(*[F.when(F.col(f"{mark}{k}") if mark == "m" else F.col(f"{mark}{k}") > 0, F.lit(n)) for k, n in enumerate(names)])) if names else none
    return out.withColumn("best", best).select(
        "document_id", F.when(F.col("best.hits") > 0, F.col("best.domain")).otherwise("general").alias("domain"), F.col("best.hits").alias("hits"), some("d", list(words)).alias("domains"), some("m", list(config.get("metric_patterns", {}))).alias("metrics")
    )

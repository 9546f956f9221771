"""Settings of a run, and the monitored sites."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SITE = (
    "domain string, name string, sitemaps array<string>, feeds array<string>, include_patterns array<string>, exclude_patterns array<string>"
)


@dataclass(frozen=True)
class Settings:
    max_pages_per_domain: int = 10_000
    max_hash_per_domain: int = 50
    request_delay_seconds: float = 2.0
    request_timeout_seconds: float = 30.0
    max_changes_history: int = 5_000
    removal_threshold_runs: int = 2
    max_missing_checks: int = 50
    first_run_scope: str = "global"  # or "site": a site's own first run emits nothing
    feeds_bypass_filters: bool = True
    html_only: bool = False


@dataclass(frozen=True)
class Config:
    settings: Settings = field(default_factory=Settings)
    sites: tuple[dict[str, Any], ...] = ()

    def site_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s["domain"], s["name"], *(list(s.get(k) or []) for k in ("sitemaps", "feeds", "include_patterns", "exclude_patterns")))
            for s in self.sites
        ]
        return spark.createDataFrame(rows, SITE)


def read_config(raw: dict[str, Any]) -> Config:
    """Unknown settings are ignored; missing ones take the defaults."""
    known = {f.name for f in fields(Settings)}
    given = {k: v for k, v in (raw.get("settings") or {}).items() if k in known}
    return Config(Settings(**given), tuple(raw.get("competitors") or ()))


def load_config(path: str) -> Config:
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return read_config(json.load(f))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML file needs PyYAML; read_config takes the same settings as a dict") from e
    with open(path, encoding="utf-8") as f:
        return read_config(yaml.safe_load(f) or {})

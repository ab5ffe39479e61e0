"""Configuration, source registry and state files (driver side)."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import SEEN_CAP, SOURCE
from .html import PARSERS


@dataclass
class Source:
    key: str
    name: str
    type: str
    list_url: str
    enabled: bool = True
    supports_enrich: bool = True
    page_param: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def paginates(self) -> bool:
        said = self.extra.get("supports_pagination")
        return bool(self.page_param) if said is None else bool(said)


@dataclass
class Config:
    """Limits, recipients, models and sources, with the defaults of a monitor."""

    list_limit: int = 30
    max_pages: int = 10
    baseline_pages: int = 3
    max_new_per_source: int = 50
    delay_sec: float = 1.0
    timeout_sec: float = 30.0
    max_attach_mb: int = 15
    recipients: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)

    @property
    def max_attach_bytes(self) -> int:
        return self.max_attach_mb * 1024 * 1024

    def selected(self, only: Sequence[str] = ()) -> list[Source]:
        return [s for s in self.sources if s.enabled and (not only or s.key in only)]


def split_recipients(value: str | None) -> list[str]:
    return [x.strip() for x in re.split("[,;]", value or "") if x.strip()]


def model_chain(*names: str | None) -> list[str]:
    """Trimmed, without blanks, each once."""
    return list(dict.fromkeys(n.strip() for n in names if n and n.strip()))


def load_config(data: Mapping, env: Mapping[str, str] | None = None) -> Config:
    """A configuration from parsed YAML or JSON and environment variables; unknown keys of a source go to ``extra``."""
    env = os.environ if env is None else env
    fields = {"key", "name", "type", "list_url", "enabled", "supports_enrich", "page_param"}
    sources = []
    for raw in data.get("sources") or []:
        if raw.get("type") not in PARSERS and raw.get("type") != "json":
            raise ValueError(f"unknown source type: {raw.get('type')}")
        sources.append(Source(**{k: v for k, v in raw.items() if k in fields}, extra={k: v for k, v in raw.items() if k not in fields}))
    plain = {k: data[k] for k in ("list_limit", "max_pages", "baseline_pages", "max_new_per_source", "delay_sec", "timeout_sec", "max_attach_mb") if k in data}
    return Config(**plain, recipients=split_recipients(env.get("MAIL_TO") or data.get("mail_to")), models=model_chain(env.get("LLM_MODEL"), data.get("model"), *(data.get("fallback_models") or [])), sources=sources)


def missing_settings(env: Mapping[str, str], needed: Sequence[str] = ("SMTP_HOST", "SMTP_USER", "SMTP_PASSWORD", "MAIL_TO")) -> list[str]:
    return [n for n in needed if not env.get(n)]


def sources_frame(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(s.key, s.name, s.type, s.list_url, s.enabled, s.supports_enrich, s.paginates, i) for i, s in enumerate(config.sources)]
    return spark.createDataFrame(rows, SOURCE)


class State:
    """Seen ids of each source in a JSON file, replaced atomically; an unreadable file is an empty state."""

    def __init__(self, path: str | Path) -> None:
        self.path, self.data = Path(path), {}
        try:
            self.data = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            pass
        if not isinstance(self.data, dict):
            self.data = {}

    def is_baselined(self, source: str) -> bool:
        return bool(self.data.get(source, {}).get("baselined"))

    def seen(self, source: str) -> list[str]:
        return self.data.get(source, {}).get("seen", [])

    def mark(self, source: str, ids: Sequence[str], baselined: bool = True) -> None:
        entry = self.data.setdefault(source, {"seen": [], "baselined": False})
        entry["seen"] = list(dict.fromkeys([*ids, *entry["seen"]]))[:SEEN_CAP]
        entry["baselined"] = entry["baselined"] or baselined

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.path.parent, delete=False, encoding="utf-8") as f:
            json.dump(self.data, f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, self.path)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(source_key, post_id, ord) of all seen ids."""
        rows = [(k, i, n) for k, v in self.data.items() for n, i in enumerate(v.get("seen", []), 1)]
        return spark.createDataFrame(rows, "source_key string, post_id string, ord int")


def capture_target(bill_id: str, url: str, template: str, host: str) -> tuple[str, str]:
    """(id, URL) of a page to capture: HTTPS on the host with one non-empty ``billId`` that agrees with the id given."""
    from urllib.parse import parse_qs, urlparse

    if not url:
        if not bill_id:
            raise ValueError("an id or a URL is needed")
        return bill_id, template.format(bill_id=bill_id)
    parts = urlparse(url)
    if parts.scheme != "https" or parts.hostname != host:
        raise ValueError("not an HTTPS URL of the expected host")
    ids = [v for k, vs in parse_qs(parts.query, keep_blank_values=True).items() if k.lower() == "billid" for v in vs]
    if len(ids) != 1 or not ids[0]:
        raise ValueError("exactly one non-empty billId is needed")
    if bill_id and bill_id != ids[0]:
        raise ValueError("the URL belongs to another id")
    return ids[0], url

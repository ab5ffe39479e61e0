"""Summaries by an external model behind a small client protocol.

Rows are packed into batches in order, a batch is one call, answers are joined
back by id.  Calls run inside Arrow group functions, one group a batch, so a
batch fits a task by its limits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import folds, relops

MARKER = re.compile(r"^(?:[-–—]+\s+|[•*·▪◦]+\s*|\(?\d{1,2}[.)]\s+)")


class Client(Protocol):
    def __call__(self, items: list[tuple[str, str]]) -> dict:
        """A response for (id, text) items: candidates with a text and a finish reason."""


def stub(lines: int = 3) -> Client:
    """A client without a model: the first sentences of each text, the same for the same input."""

    def call(items: list[tuple[str, str]]) -> dict:
        rows = []
        for i, text in items:
            parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if p.strip()]
            rows.append({"bill_id": i, "summary": [p[:200] for p in (parts + ["-"] * lines)[:lines]]})
        return {"candidates": [{"content": {"parts": [{"text": json.dumps({"summaries": rows}, ensure_ascii=False)}]}, "finishReason": "STOP"}]}

    return call


def prompt(item_id: str, title: str, text: str, lines: int) -> str:
    return f"[id] {item_id}\n[title] {title}\n[text]\n{text}\nAnswer with {lines} lines as JSON: {json.dumps({'summary': ['...'] * lines})}"


def generation_config(model: str, lines: int) -> dict:
    """Options by model family: only the one that accepts them gets thinking and temperature options."""
    config: dict = {"responseMimeType": "application/json", "maxOutputTokens": 4096}
    if re.match(r"^gemini-2\.5-", (model or "").strip().lower()):
        config |= {"maxOutputTokens": 1024, "temperature": 0.2, "thinkingConfig": {"thinkingBudget": 0}}
    return config


def fallback_order(models: list[str], active: str | None, gone: set[str]) -> list[str]:
    """The active model first, then the others in order, without those that are gone."""
    return [m for m in dict.fromkeys([*([active] if active else []), *models]) if m not in gone]


def text_of(response: dict) -> tuple[str, str]:
    """(finish reason, text) of a response."""
    cands = response.get("candidates") or []
    reason = str((cands[0].get("finishReason") or "") if cands else "")
    for c in cands:
        joined = "".join(p.get("text", "") for p in (c.get("content") or {}).get("parts") or [] if isinstance(p, dict)).strip()
        if joined:
            return reason, joined
    return reason, ""


def parse_batch(response: dict, wanted: set[str], lines: int, most: int) -> tuple[dict[str, list[str]], str]:
    """Accepted summaries by id and the outcome (ok, split, failed).  An id that
    comes twice, isn't asked for or has bad lines is left out."""
    reason, text = text_of(response)
    if reason == "MAX_TOKENS":
        return {}, "split"
    if reason != "STOP":
        return {}, "failed"
    text = re.sub(r"^```[^\n]*\n|```\s*$", "", text).strip()
    try:
        rows = json.loads(text)
    except ValueError:
        return {}, "split"
    rows = rows.get("summaries") if isinstance(rows, dict) else rows
    if not isinstance(rows, list):
        return {}, "failed"
    rows = [r for r in rows if isinstance(r, dict) and isinstance(r.get("bill_id"), str)]
    times: dict[str, int] = {}
    for r in rows:
        times[r["bill_id"]] = times.get(r["bill_id"], 0) + 1
    out = {}
    for r in rows:
        s = r.get("summary")
        if times[r["bill_id"]] > 1 or r["bill_id"] not in wanted or not isinstance(s, list) or len(s) != lines or not all(isinstance(x, str) for x in s):
            continue
        s = [MARKER.sub("", " ".join(x.split()), count=1).strip() for x in s]
        if all(0 < len(x) <= most and re.search("[0-9A-Za-z가-힣一-龥]", x) for x in s):
            out[r["bill_id"]] = s
    return out, "ok"


def summarise_items(items: list[tuple[str, str]], client: Client, lines: int, most: int) -> dict[str, list[str]]:
    """One batch: a call, halves once if it is too large, one more call for what is missing."""

    def ask(part: list[tuple[str, str]]) -> tuple[dict[str, list[str]], str]:
        try:
            return parse_batch(client(part), {i for i, _ in part}, lines, most)
        except Exception:  # noqa: BLE001  a failed call leaves its rows without summary
            return {}, "failed"

    got, outcome = ask(items)
    if outcome == "split" and len(items) > 1:
        for half in (items[: len(items) // 2], items[len(items) // 2 :]):
            got |= ask(half)[0]
    missing = [x for x in items if x[0] not in got]
    if missing and outcome != "failed":
        got |= ask(missing)[0]
    return got


def summarise(posts: DataFrame, client_factory: Callable[[], Client], *, by: str, order: str, id_col: str, text_col: str, least: int = 0, batch_rows: int = 25, batch_chars: int = 250_000, lines: int = 3, most: int = 200) -> DataFrame:
    """(id, summary): a row for each post, null without a summary.

    Rows with fewer than ``least`` squished characters aren't asked about; a
    repeated id is asked once.
    """
    squished = posts.select(by, order, F.col(id_col).cast("string").alias("id"), T.squish(text_col).alias("text"))
    targets = relops.first_wins(squished.where(F.length("text") >= max(1, least)), ["id"], [by, order]).withColumn("size", F.length("text"))
    packed = folds.greedy_batches(targets, by, order, "size", batch_rows, batch_chars)
    rows = targets.join(packed, [by, order]).select(by, "batch", order, "id", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got = summarise_items(list(zip(pdf["id"], pdf["text"], strict=True)), client_factory(), lines, most)
        return pd.DataFrame({"id": pd.Series(list(got), dtype=object), "summary": pd.Series(list(got.values()), dtype=object)})

    answers = rows.groupBy(by, "batch").applyInPandas(run, "id string, summary array<string>")
    return squished.select("id").join(answers, "id", "left")

"""A model client: models in order, a pause between calls, retries, a hard bound on time.

It is made once a task (``client_factory`` of ``summarize``), so what it learns
of models and the pause between calls hold within that task.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from .summarize import fallback_order, generation_config, prompt

#: Answers worth another try; least seconds that a call is worth starting for.  Fixed values.
RETRY, LEAST_CALL = (429, 500, 502, 503, 504), 5.0


class OutOfTime(RuntimeError):
    """The time for a call, or for all of them, is over."""


class NoModel(RuntimeError):
    """None of the models can be used."""


#: (status, body) of a request (model, payload, seconds).
Transport = Callable[[str, dict, float], tuple[int, str]]


def error_fields(body: str) -> tuple[str, str]:
    """Status and message of an error; of a body that isn't JSON its beginning."""
    try:
        e = json.loads(body)
    except ValueError:
        return "", body[:200]
    e = (e or {}).get("error") if isinstance(e, dict) else None
    return (str(e.get("status") or ""), str(e.get("message") or "")) if isinstance(e, dict) else ("", "")


def gone(status: int, body: str) -> bool:
    """The model doesn't exist or isn't offered: another try gives the same."""
    kind, message = error_fields(body)
    return status == 404 or kind == "NOT_FOUND" or (status in (400, 403) and "not found" in message.lower())


def within(seconds: float, call: Callable[[], object]) -> object:
    """The call's result; ``OutOfTime`` if it takes longer, however it spends its time.  The thread left behind is a daemon."""
    box: list = []

    def work() -> None:
        try:
            box.append((call(), None))
        except BaseException as e:  # noqa: BLE001  raised again by the caller
            box.append((None, e))

    worker = threading.Thread(target=work, daemon=True)
    worker.start()
    worker.join(seconds)
    if not box:
        raise OutOfTime(f"no answer within {seconds:.1f} s")
    value, error = box[0]
    if error is not None:
        raise error
    return value


@dataclass
class ModelClient:
    """``models`` in order of preference.  A model that is gone isn't asked
    again; the one that answered last is asked first.  ``per_minute``: calls, 0
    for no pause.  ``seconds``: of one call; ``total``: of all of this client's
    calls, pauses included, None for no bound.  ``key`` empty: not available."""

    models: list[str]
    transport: Transport
    key: str = "-"
    per_minute: int = 10
    seconds: float = 30.0
    total: float | None = None
    retries: int = 2
    backoff: float = 2.0
    lines: int = 3
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    active: str | None = None
    missing: set[str] = field(default_factory=set)
    plain: set[str] = field(default_factory=set)
    last: float | None = None
    began: float | None = None

    @property
    def available(self) -> bool:
        return bool(self.key) and bool(self.models)

    def left(self) -> float:
        if self.total is None:
            return float("inf")
        self.began = self.clock() if self.began is None else self.began
        return self.total - (self.clock() - self.began)

    def pause(self) -> None:
        """Waits until the interval since the last call is over, but not beyond the time that is left."""
        if self.per_minute > 0 and self.last is not None:
            wait = 60.0 / self.per_minute - (self.clock() - self.last)
            if wait > 0:
                self.sleep(min(wait, max(0.0, self.left())))

    def payload(self, model: str, text: str) -> dict:
        config = generation_config(model, self.lines)
        if model in self.plain:
            config.pop("thinkingConfig", None)
        return {"contents": [{"role": "user", "parts": [{"text": text}]}], "generationConfig": config}

    def ask(self, model: str, text: str) -> dict | None:
        """The model's response; None if it is gone.

        Passing trouble is tried again while the time left allows the wait and a
        call.  A refusal (400) of the optional setting that was sent drops it for
        this model, once, without counting as a try.
        """
        tried, said = 0, ""
        while tried <= self.retries:
            self.pause()
            budget = min(self.seconds, self.left())
            if budget <= 0:
                raise OutOfTime(said or "the time for all calls is over")
            body = self.payload(model, text)
            self.last = self.clock()
            status, answer = within(budget, lambda body=body, budget=budget: self.transport(model, body, budget))
            if status == 200:
                return json.loads(answer)
            said = f"HTTP {status}: {answer[:300]}"
            if gone(status, answer):
                return None
            if status == 400 and "thinkingConfig" in body["generationConfig"]:
                self.plain.add(model)
                continue
            wait = self.backoff * 2**tried
            if status not in RETRY or tried == self.retries or wait + LEAST_CALL > self.left():
                break
            self.sleep(wait)
            tried += 1
        raise RuntimeError(said)

    def generate(self, text: str) -> dict:
        """The response of the first model that isn't gone."""
        for model in fallback_order(self.models, self.active, self.missing):
            response = self.ask(model, text)
            if response is not None:
                self.active = model
                return response
            self.missing.add(model)
            self.active = None if self.active == model else self.active
        raise NoModel(f"none of {', '.join(self.models) or 'no models'} can be used")

    def __call__(self, items: list[tuple[str, str]]) -> dict:
        return self.generate("\n\n".join(prompt(i, "", text, self.lines) for i, text in items))

"""A thin session object: lifecycle, registered capabilities and request dispatch around a SparkSession."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# The life of an engine.
STEPS = {"created": ("started",), "started": ("registered", "stopped"), "registered": ("ready", "stopped"), "ready": ("serving", "stopped"), "serving": ("draining",), "draining": ("stopped",), "stopped": ()}


class EngineError(RuntimeError):
    """A request or lifecycle step that isn't allowed now."""


@dataclass
class Engine:
    spark: SparkSession
    engine_id: str = "factloom"
    instance: str = "local"
    state: str = "created"
    capabilities: dict[str, Callable] = field(default_factory=lambda: {"echo": lambda payload: payload})

    def move(self, state: str) -> None:
        if state not in STEPS[self.state]:
            raise EngineError(f"an engine that is {self.state} can't become {state}")
        self.state = state

    def start(self) -> Engine:
        for state in ("started", "registered", "ready", "serving"):
            self.move(state)
        return self

    def stop(self) -> None:
        if self.state == "serving":
            self.move("draining")
        self.move("stopped")

    def register(self, name: str, handler: Callable) -> None:
        if not name.strip() or name in self.capabilities:
            raise EngineError(f"capability {name!r} can't be registered")
        self.capabilities[name] = handler

    def handle(self, capability: str, payload, engine_id: str | None = None, instance: str | None = None):
        """Dispatches a request; it must be serving, and the request meant for it."""
        if self.state != "serving":
            raise EngineError(f"the engine is {self.state}")
        if (engine_id or self.engine_id) != self.engine_id or (instance or self.instance) != self.instance:
            raise EngineError("the request is for another engine")
        if capability not in self.capabilities:
            raise EngineError(f"unknown capability {capability!r}")
        return self.capabilities[capability](payload)

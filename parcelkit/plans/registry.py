"""Named components: what a configuration file can ask for, and what users add."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from pathlib import Path

STEPS = ("source", "reader", "preprocessor", "marker", "storage", "dump")
_components: dict[str, dict[str, Callable]] = {s: {} for s in STEPS}


def register(step: str, name: str | None = None) -> Callable[[Callable], Callable]:
    """Decorator: registers a function or class for a step under its own or another name."""
    if step not in _components:
        raise ValueError(f"no such step: {step}")

    def add(component: Callable) -> Callable:
        _components[step][name or component.__name__] = component
        return component

    return add


def names(step: str) -> list[str]:
    return sorted(_components[step])


def get(step: str, name: str) -> Callable:
    if name not in _components[step]:
        raise ValueError(f"no {step} called {name}; there are {names(step)}")
    return _components[step][name]


def build(step: str, spec: dict) -> object:
    """The component of a mapping with 'kind' and parameters."""
    spec = dict(spec)
    return get(step, spec.pop("kind"))(**spec)


def load(module: str, base: Path | None = None) -> None:
    """Imports a module, or a file by its path, so that it registers its components."""
    if not module.endswith(".py"):
        importlib.import_module(module)
        return
    path = Path(module) if Path(module).is_absolute() or base is None else base / module
    spec = importlib.util.spec_from_file_location(path.stem, path)
    found = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(found)

"""Running markers over elements: read, preprocess, compute, store.

There is no loop over elements. One lazy plan is built for each feature over a signal that all
markers share; the signal is kept while more than one marker reads it.
"""

from __future__ import annotations

import importlib.util
import logging
import shutil
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from parcelkit.model import DATA_TYPES, KINDS
from parcelkit.operators import dims
from parcelkit.sources import datasets
from parcelkit.sources import elements as element_tables
from parcelkit.sources.store import FeatureStore

from . import registry
from .markers import Marker
from .steps import Step

logger = logging.getLogger("parcelkit")


class MarkerCollection:
    """Preprocessors and markers over signals with ``keys``, and the store for their features.

    A preprocessor is a Step, or a plain function of a signal. ``about`` goes to the catalog with every
    feature.
    """

    def __init__(self, markers: Sequence[Marker], preprocessors: Sequence[Step | Callable[[DataFrame], DataFrame]] = (), store: FeatureStore | None = None, dump: str | None = None, dump_all: bool = False, keys: Sequence[str] | None = None, about: dict | None = None):
        names = [m.name for m in markers]
        if len(set(names)) != len(names):
            raise ValueError("markers need names of their own")
        self.markers, self.store, self.dump, self.dump_all, self.about = list(markers), store, dump, dump_all, about or {}
        self.steps = [p if isinstance(p, Step) else Step(getattr(p, "__name__", "step"), lambda s, keys, extra, p=p: p(s), tuple(DATA_TYPES)) for p in preprocessors]
        self.keys = list(keys) if keys is not None else list(store.keys) if store is not None else ["element"]

    def validate(self, types: Sequence[str]) -> None:
        """Checks, without any data, that types are known, steps and markers apply, packages are there and kinds can be stored."""
        if unknown := [t for t in types if t not in DATA_TYPES]:
            raise ValueError(f"unknown types: {unknown}")
        for part in (*self.steps, *self.markers):
            if not set(part.on) & set(types):
                raise ValueError(f"{part.name} works on none of {list(types)}")
        for m in self.markers:
            if missing := [d for d in m.dependencies if importlib.util.find_spec(d) is None]:
                raise ImportError(f"{m.name} needs {missing}")
            if missing := [p for p in m.programs if shutil.which(p) is None]:
                raise ImportError(f"{m.name} needs the programs {missing}")
            for kind in m.kinds.values():
                if kind not in KINDS or self.store is not None and kind not in self.store.kinds:
                    raise ValueError(f"{kind} of {m.name} can't be stored")

    def prepared(self, signal: DataFrame, data_type: str = "BOLD", extra: dict[str, DataFrame] | None = None) -> DataFrame:
        """The signal after all steps that work on its type; ``extra`` is what was read with it."""
        extra, mine = dict(extra or {}), [p for p in self.steps if data_type in p.on]
        for k, step in enumerate(mine):
            logger.info("%s: %s", data_type, step.name)
            found = step.run(signal, self.keys, extra)
            signal, changed = found if isinstance(found, tuple) else (found, {})
            extra |= changed
            if self.dump and (self.dump_all or k == len(mine) - 1):
                folder = f"{self.dump}/{data_type}/step_{k}"
                signal.write.mode("overwrite").parquet(folder)
                signal = signal.sparkSession.read.parquet(folder)
        return signal

    def fit(self, data: dict[str, DataFrame], meta: dict | None = None, if_stored: str = "skip") -> dict[str, dict[str, dict[str, DataFrame]]]:
        """{marker: {type: {feature: DataFrame}}}; with a store, the features are written too.

        ``data`` holds a signal for each type, and under type.name what belongs to it.
        """
        signals = {t: df for t, df in data.items() if "." not in t}
        self.validate(list(signals))
        out: dict[str, dict[str, dict[str, DataFrame]]] = {}
        for data_type, signal in signals.items():
            mine = [m for m in self.markers if data_type in m.on]
            if not mine:
                continue
            signal = self.prepared(signal, data_type, {t.split(".", 1)[1]: df for t, df in data.items() if t.startswith(f"{data_type}.")})
            if self.store is not None and len(mine) > 1:
                signal = signal.persist()
            steps = [{"name": p.name} | {k: v for k, v in p.params.items() if v is not None} for p in self.steps if data_type in p.on]
            for m in mine:
                found = m.features(signal, self.keys)
                out.setdefault(m.name, {})[data_type] = {f: df for f, (_, df) in found.items()}
                for feature, (kind, df) in found.items() if self.store is not None else ():
                    logger.info("%s: storing %s of %s", data_type, feature, m.name)
                    about = {"element": {k: "" for k in self.keys}, "type": data_type, "marker": {"name": f"{m.name}_{feature}"} | m.params}
                    about |= {"preprocess": steps} if steps else {}
                    about |= {"dependencies": sorted(m.dependencies)} if m.dependencies else {}
                    self.store.store(kind, df, about | self.about | (meta or {}), if_stored)
            if self.store is not None and len(mine) > 1:
                signal.unpersist()
        return out


def read_dump(spark: SparkSession, location: str, data_type: str = "BOLD", step: int = 0) -> DataFrame:
    """A signal that was dumped after a step."""
    return spark.read.parquet(f"{location}/{data_type}/step_{step}")


def parse_yaml(path: str | Path) -> dict:
    """A configuration: imports what 'with' names; relative paths are relative to the file."""
    import yaml

    path = Path(path)
    config = yaml.safe_load(path.read_text())
    extra = config.pop("with", [])
    for module in [extra] if isinstance(extra, str) else extra:
        registry.load(module, path.parent)
    def beside(text: str) -> str:
        return text if "://" in text or Path(text).is_absolute() else str((path.parent / text).resolve())

    for part, name in (("storage", "uri"), ("source", "datadir"), ("dump", "location")):
        if name in config.get(part, {}):
            config[part][name] = beside(config[part][name])
    for spec in config.get("data", []):
        spec["path"] = beside(spec["path"])
        if isinstance(spec.get("labels"), str):
            spec["labels"] = beside(spec["labels"])
    if "tables" in config.get("source", {}):
        config["source"]["tables"] = {t: beside(p) for t, p in config["source"]["tables"].items()}
    return config


def run(spark: SparkSession, config: dict, selectors: Sequence | None = None, overwrite: bool = False) -> FeatureStore:
    """Runs a configuration: data, source, preprocess, markers, storage. Selectors that match nothing are an error.

    'elements' of the configuration hold where no selectors are given. ``overwrite`` replaces the
    elements that are stored, which are skipped otherwise.
    """
    for spec in config.get("data", []):
        dims.register_data(spec["kind"], spec["name"], spec["path"], True, labels=spec.get("labels"))
    with datasets.opened(registry.build("source", config["source"] | {"spark": spark})) as source:
        return _run(spark, config, source, selectors, overwrite)


def _run(spark: SparkSession, config: dict, source: datasets.Source, selectors: Sequence | None, overwrite: bool) -> FeatureStore:
    found = source.elements()
    keys = found.columns
    selectors = selectors if selectors is not None else config.get("elements")
    if selectors:
        if wrong := element_tables.unmatched(found, selectors):
            raise ValueError(f"no such elements: {wrong}")
        found = element_tables.select(found, selectors)
    data = {}
    for t, df in source.signals().items():
        on = [k for k in keys if k in df.columns]
        # A type with fewer keys, as a picture of the whole subject is, belongs to each element with these keys.
        data[t] = df.join(found, on, "left_semi") if len(on) == len(keys) else df.join(found, on)
    options = config["storage"]
    store = FeatureStore(spark, options["uri"], keys, options.get("force_float32", True), single_output=options.get("single_output", True))
    steps = [registry.build("preprocessor", p) for p in config.get("preprocess", [])]
    markers = [registry.build("marker", m) for m in config["markers"]]
    dump = config.get("dump", {})
    about = {"datagrabber": {k: v for k, v in config["source"].items() if isinstance(v, str | int | float | bool | list)}}
    MarkerCollection(markers, steps, store, dump.get("location"), dump.get("granularity") == "full", keys, about).fit(data, if_stored="update" if overwrite else "skip")
    return store


def collect(spark: SparkSession, uri: str, parts: Sequence[str], keys: Sequence[str] | None = None, files: int | None = None) -> FeatureStore:
    """One store of several; the keys are those of the parts."""
    others = [FeatureStore.open(spark, p) for p in parts]
    store = FeatureStore(spark, uri, keys or next((o.keys for o in others if o.keys), []))
    store.collect(others, files)
    return store


def list_elements(spark: SparkSession, config: dict, selectors: Sequence | None = None) -> DataFrame:
    source = registry.build("source", config["source"] | {"spark": spark})
    getattr(source, "open", lambda: None)()
    found = source.elements()
    return element_tables.as_lines(element_tables.select(found, selectors) if selectors else found)


def reset(spark: SparkSession, config: dict) -> None:
    """Deletes the configured store's own folders."""
    FeatureStore(spark, config["storage"]["uri"], []).reset()


def queue(path: str, submit: str = "spark-submit", **conf: str) -> str:
    """The command that runs a configuration on a cluster; Spark's scheduler is the queue."""
    options = " ".join(f"--conf {k.replace('__', '.')}={v}" for k, v in sorted(conf.items()))
    return " ".join(x for x in (submit, options, "-m parcelkit.plans.cli run", str(path)) if x)

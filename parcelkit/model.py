"""Schemas of features and the identity of a feature in the catalog.

A signal is long: element keys, timepoint, voxel, value. A feature is long too, in one of five kinds.
"""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import types as T

#: Columns of each kind of feature besides the element keys.
KINDS: dict[str, list[tuple[str, T.DataType]]] = {
    "vector": [("col", T.StringType()), ("col_idx", T.IntegerType()), ("value", T.DoubleType())],
    "matrix": [("row", T.StringType()), ("row_idx", T.IntegerType()), ("col", T.StringType()), ("col_idx", T.IntegerType()), ("value", T.DoubleType())],
    "timeseries": [("timepoint", T.IntegerType()), ("col", T.StringType()), ("col_idx", T.IntegerType()), ("value", T.DoubleType())],
    "timeseries_2d": [("timepoint", T.IntegerType()), ("row", T.StringType()), ("col", T.StringType()), ("value", T.DoubleType())],
    "scalar_table": [("row", T.StringType()), ("col", T.StringType()), ("value", T.DoubleType())],
}

#: Kinds of input data and their dimensions (4: with time); more can be registered.
DATA_TYPES: dict[str, int] = {
    "T1w": 3, "T2w": 3, "BOLD": 4, "Warp": 0, "VBM_GM": 3, "VBM_WM": 3, "VBM_CSF": 3,
    "fALFF": 3, "GCOR": 3, "LCOR": 3, "DWI": 4, "FreeSurfer": 0,
}


def key_schema(df, keys: Sequence[str]) -> str:
    """The keys' columns of a DataFrame, as the beginning of a kernel's schema."""
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def key_columns(key: tuple, schema: pa.Schema, n: int) -> dict:
    """A group's key as ``n`` equal rows; the keys are the first columns of ``schema``."""
    return {schema[k].name: pa.array([v.as_py()] * n, schema[k].type) for k, v in enumerate(key)}


def register_data_type(name: str, dimensions: int = 3) -> None:
    if name in DATA_TYPES:
        raise ValueError(f"{name} is registered already")
    DATA_TYPES[name] = dimensions


def schema(kind: str, keys: Sequence[str], key_type: T.DataType | None = None) -> T.StructType:
    """Schema of a feature of ``kind``."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    return T.StructType([*(T.StructField(k, key_type or T.StringType()) for k in keys), *(T.StructField(n, t) for n, t in KINDS[kind])])


def feature_identity(meta: dict) -> tuple[str, str, dict]:
    """(md5, name, cleaned meta) of a feature.

    ``meta`` needs element, type and marker.name. The hash ignores the order of keys and the element's
    values, but not its keys; a dataset's folder doesn't count where a uri names the dataset.
    """
    meta = copy.deepcopy(meta)
    if "element" not in meta:
        raise ValueError("meta has no element")
    element = meta.pop("element")
    if "type" not in meta or "name" not in meta.get("marker", {}):
        raise ValueError("meta needs type and marker.name")
    meta["_element_keys"] = list(element) if isinstance(element, dict) else ["element"]
    name = f"{meta['type']}_{meta['marker']['name']}"
    meta["name"] = name
    meta.get("dependencies") is None and meta.pop("dependencies", None)
    source = meta.get("datagrabber", {})
    if "uri" in source:
        source.pop("datadir", None)
    return hashlib.md5(json.dumps(meta, sort_keys=True, default=str).encode()).hexdigest(), name, meta


def element_prefix(element: dict | str) -> str:
    """Prefix of an element's own file."""
    values = element.values() if isinstance(element, dict) else [element]
    return "element_" + "_".join(map(str, values)) + "_"

"""Preprocessing steps by name, for configuration files.

A step gets the signal, its keys and what else was read with it (its type's masks and confounds), and
gives a signal, or a pair of signal and changed confounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelkit.operators import dims, prep

from .registry import register

#: Signal, keys, {name: what belongs to the signal} -> signal, or (signal, changed entries).
Run = Callable[[DataFrame, Sequence[str], dict[str, DataFrame]], DataFrame | tuple[DataFrame, dict[str, DataFrame]]]


@dataclass
class Step:
    name: str
    run: Run
    on: Sequence[str] = ("BOLD",)
    params: dict = field(default_factory=dict)


def _mask(masks: object, signal: DataFrame, extra: dict[str, DataFrame]) -> DataFrame | None:
    inherit = extra["mask"].where("value > 0").select("voxel") if "mask" in extra else None
    return None if masks is None else dims.mask_of(masks, signal.sparkSession, signal, inherit)


@register("preprocessor")
def slice_time(start: float = 0.0, stop: float | None = None, duration: float | None = None, t_r: float = 1.0, on: Sequence[str] = ("BOLD",)) -> Step:
    """Frames of a span of seconds, of the signal and of its confounds."""

    def run(signal: DataFrame, keys: Sequence[str], extra: dict[str, DataFrame]):
        frames = signal.agg(F.max("timepoint")).first()[0]
        first, last = prep.slice_bounds((frames if frames is not None else -1) + 1, start, stop, duration, t_r)
        changed = {"confounds": prep.slice_time(extra["confounds"], first, last)} if "confounds" in extra else {}
        return prep.slice_time(signal, first, last), changed

    return Step("slice_time", run, on, {"start": start, "stop": stop, "duration": duration, "t_r": t_r})


@register("preprocessor")
def temporal_filter(detrend: bool = True, standardize: bool = True, low_pass: float | None = None, high_pass: float | None = None, t_r: float = 1.0, masks: object = None, on: Sequence[str] = ("BOLD",)) -> Step:
    def run(signal: DataFrame, keys: Sequence[str], extra: dict[str, DataFrame]) -> DataFrame:
        return prep.temporal_filter(signal, detrend, standardize, low_pass, high_pass, t_r, keys=keys, mask=_mask(masks, signal, extra))

    return Step("temporal_filter", run, on, {"detrend": detrend, "standardize": standardize, "low_pass": low_pass, "high_pass": high_pass, "t_r": t_r})


@register("preprocessor")
def remove_confounds(strategy: dict[str, str] | None = None, spike: float | None = None, scrub: int | None = None, fd_threshold: float = 0.5, std_dvars_threshold: float = 1.5, detrend: bool = True, standardize: bool = True, low_pass: float | None = None, high_pass: float | None = None, t_r: float = 1.0, masks: object = None, mapping: dict[str, str] | None = None, on: Sequence[str] = ("BOLD",)) -> Step:
    """Confounds are those read with the signal; ``mapping`` names their columns where they are called otherwise."""

    def run(signal: DataFrame, keys: Sequence[str], extra: dict[str, DataFrame]) -> DataFrame:
        if "confounds" not in extra:
            raise ValueError("the signal has no confounds")
        confounds = prep.rename_confounds(extra["confounds"], mapping) if mapping else extra["confounds"]
        return prep.confound_remover(signal, confounds, strategy, spike, scrub, fd_threshold, std_dvars_threshold, detrend, standardize, low_pass, high_pass, t_r, _mask(masks, signal, extra), keys=keys)

    return Step("remove_confounds", run, on, {"strategy": strategy, "spike": spike, "scrub": scrub, "fd_threshold": fd_threshold, "std_dvars_threshold": std_dvars_threshold, "detrend": detrend, "standardize": standardize, "low_pass": low_pass, "high_pass": high_pass, "t_r": t_r})


@register("preprocessor")
def smooth(fwhm: float, grid: str, voxel_size: float = 1.0, on: Sequence[str] = ("T1w", "T2w", "BOLD")) -> Step:
    def run(signal: DataFrame, keys: Sequence[str], extra: dict[str, DataFrame]) -> DataFrame:
        return prep.smooth(signal, dims.load_data("grid", grid, signal.sparkSession), fwhm, voxel_size, keys=keys)

    return Step("smooth", run, on, {"fwhm": fwhm, "grid": grid, "voxel_size": voxel_size})


@register("preprocessor")
def warp(lookup: str, on: Sequence[str] = ("T1w", "T2w", "BOLD", "VBM_GM", "VBM_WM", "VBM_CSF", "fALFF", "GCOR", "LCOR")) -> Step:
    """Values in another space, by a table (voxel, target) at a path."""

    def run(signal: DataFrame, keys: Sequence[str], extra: dict[str, DataFrame]) -> DataFrame:
        return dims.warp(signal, signal.sparkSession.read.parquet(lookup))

    return Step("warp", run, on, {"lookup": lookup})

"""Published data sets as sources: where their files lie and which keys they have.

Elements are the files that are there, limited to the tasks and the like that are asked for.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelkit.plans.registry import register

from . import readers
from .patterns import PatternSource, list_files, validate

class Source(Protocol):
    """What a pipeline needs: the elements, and by type what there is of them.

    open() is called before anything is read and close() at the end, also of a run that failed.
    """

    def elements(self) -> DataFrame: ...

    def signals(self) -> dict[str, DataFrame]: ...

    def open(self) -> None: ...

    def close(self) -> None: ...


@contextmanager
def opened(source: Source) -> Iterator[Source]:
    """The source between its open() and close(), which it need not have."""
    getattr(source, "open", lambda: None)()
    try:
        yield source
    finally:
        getattr(source, "close", lambda: None)()


#: The standard space of the preprocessed sets.
STANDARD = "MNI152NLin2009cAsym"


class FolderSource:
    """A folder whose files fit patterns: elements, and the signals and what belongs to them.

    ``limits`` maps a key to the values it may have. A type's signals come with the keys as
    columns; a nested pattern (mask, confounds) is a type of its own, called type.name. ``fetch`` and
    ``drop`` are commands, run with the folder, that bring a set of files there and take it away.
    """

    def __init__(self, spark: SparkSession, datadir: str, types: Sequence[str], patterns: dict, replacements: Sequence[str], limits: dict[str, Sequence[str]] | None = None, partial_pattern_ok: bool = False, fetch: Sequence[str] | None = None, drop: Sequence[str] | None = None):
        validate({t: patterns[t] for t in types}, replacements, types)
        self.spark, self.folder, self.fetch, self.drop = spark, datadir, fetch, drop
        self.how = types, {t: patterns[t] for t in types}, replacements, partial_pattern_ok, limits

    def open(self) -> None:
        if self.fetch:
            subprocess.run([*self.fetch, self.folder], check=True)

    def close(self) -> None:
        if self.drop:
            subprocess.run([*self.drop, self.folder], check=True)

    @cached_property
    def source(self) -> PatternSource:
        types, patterns, replacements, partial, limits = self.how
        return PatternSource(types, patterns, replacements, list_files(self.spark, self.folder), partial, limits)

    def elements(self) -> DataFrame:
        return self.source.elements()

    def signals(self) -> dict[str, DataFrame]:
        """Of each type its contents; types that are passed on by path keep their paths."""
        out: dict[str, DataFrame] = {}
        for kind in self.source.types:
            spec, files = self.source.patterns[kind], self.source.data(kind)
            if isinstance(spec, list) or kind in readers.SKIPPED or readers.extension(spec["pattern"]) is None:
                out[kind] = files
                continue
            keys = [c for c in files.columns if c in self.source.replacements]
            out[kind] = readers.read_files(self.spark, self.folder, files.select(*keys, "path"), keys, spec["pattern"])
            for name, nested in spec.items():
                if isinstance(nested, dict) and readers.extension(nested["pattern"]):
                    inner = files.select(*keys, F.col(f"{name}.path").alias("path")).where("path IS NOT NULL")
                    out[f"{kind}.{name}"] = readers.read_files(self.spark, self.folder, inner, keys, nested["pattern"])
        return out


register("source", "folder")(FolderSource)


@register("source", "tables")
class TableSource:
    """Signals that are tables already: a path of each type, with the keys, timepoint, voxel and value."""

    def __init__(self, spark: SparkSession, tables: dict[str, str], keys: Sequence[str]):
        self.spark, self.tables, self.keys = spark, tables, list(keys)

    def signals(self) -> dict[str, DataFrame]:
        return {kind: readers.read(self.spark, path) if readers.extension(path) else self.spark.read.parquet(path) for kind, path in self.tables.items()}

    def elements(self) -> DataFrame:
        found = [df for kind, df in self.signals().items() if "." not in kind]
        out = found[0].select(*self.keys).distinct()
        for other in found[1:]:
            out = out.join(other.select(*[k for k in self.keys if k in other.columns]).distinct(), [k for k in self.keys if k in other.columns], "left_semi")
        return out


def _tissues(pattern: str, space: str) -> dict[str, dict]:
    return {f"VBM_{t}": {"pattern": pattern.format(tissue=t, subject="{subject}"), "space": space} for t in ("CSF", "GM", "WM")}


def preprocessed(root: str, stem: str, space: str = STANDARD, anatomy: str = "", confounds: str = "desc-confounds_regressors.tsv", reference: bool = True) -> dict[str, dict]:
    """Patterns of a set that was preprocessed into the usual derivatives: ``stem`` begins the names of functional
    files, ``anatomy`` is a session's folder before them."""
    func = "space-T1w_" if space == "native" else f"space-{STANDARD}_"
    anat = "" if space == "native" else f"space-{STANDARD}_"
    bold = f"{root}/{{subject}}/{anatomy}func/{stem}_"
    t1w = f"{root}/{{subject}}/anat/{{subject}}_{anat}"
    out = {
        "BOLD": {
            "pattern": f"{bold}{func}desc-preproc_bold.nii.gz", "space": space,
            "mask": {"pattern": f"{bold}{func}desc-brain_mask.nii.gz", "space": space},
            "confounds": {"pattern": f"{bold}{confounds}", "format": "fmriprep"},
        },
        "T1w": {"pattern": f"{t1w}desc-preproc_T1w.nii.gz", "space": space, "mask": {"pattern": f"{t1w}desc-brain_mask.nii.gz", "space": space}},
        **_tissues(f"{root}/{{subject}}/anat/{{subject}}_{anat}label-{{tissue}}_probseg.nii.gz", space),
    }
    if reference:
        out["BOLD"]["reference"] = {"pattern": f"{bold}{func}boldref.nii.gz"}
    ends = {"native": ("T1w", STANDARD), "standard": (STANDARD, "T1w")}
    out["Warp"] = [{"pattern": f"{root}/{{subject}}/anat/{{subject}}_from-{a}_to-{b}_mode-image_xfm.h5", "src": a.replace("T1w", "native"), "dst": b.replace("T1w", "native"), "warper": "ants"} for a, b in ends.values()]
    return out


@register("source", "hcp1200")
def hcp1200(spark: SparkSession, datadir: str, types: Sequence[str] = ("BOLD", "T1w", "Warp"), tasks: Sequence[str] = ("REST1", "REST2", "SOCIAL", "WM", "RELATIONAL", "EMOTION", "LANGUAGE", "GAMBLING", "MOTOR"), phase_encodings: Sequence[str] = ("RL", "LR"), ica_fix: bool = False) -> FolderSource:
    """Tasks are called by their folders: resting ones begin with rfMRI_, others with tfMRI_."""
    if ica_fix and not all(t.startswith("REST") for t in tasks):
        raise ValueError("cleaned files are there for resting tasks only")
    run, space = "{task}_{phase_encoding}", "MNI152NLin6Asym"
    patterns = {
        "BOLD": {"pattern": f"{{subject}}/MNINonLinear/Results/{run}/{run}{'_hp2000_clean' if ica_fix else ''}.nii.gz", "space": space},
        "T1w": {"pattern": "{subject}/T1w/T1w_acpc_dc_restore.nii.gz", "space": "native"},
        "Warp": [
            {"pattern": "{subject}/MNINonLinear/xfms/standard2acpc_dc.nii.gz", "src": space, "dst": "native", "warper": "fsl"},
            {"pattern": "{subject}/MNINonLinear/xfms/acpc_dc2standard.nii.gz", "src": "native", "dst": space, "warper": "fsl"},
        ],
    }
    named = [f"{'r' if t.startswith('REST') else 't'}fMRI_{t}" for t in tasks]
    return FolderSource(spark, datadir, types, patterns, ["subject", "task", "phase_encoding"], {"task": named, "phase_encoding": phase_encodings})


@register("source", "aomic_id1000")
def aomic_id1000(spark: SparkSession, datadir: str, types: Sequence[str] = ("BOLD", "T1w", "VBM_CSF", "VBM_GM", "VBM_WM"), space: str = STANDARD) -> FolderSource:
    return FolderSource(spark, datadir, types, preprocessed("derivatives/fmriprep", "{subject}_task-moviewatching", space), ["subject"])


@register("source", "aomic_piop")
def aomic_piop(spark: SparkSession, datadir: str, types: Sequence[str] = ("BOLD", "T1w", "VBM_CSF", "VBM_GM", "VBM_WM"), tasks: Sequence[str] | None = None, space: str = STANDARD) -> FolderSource:
    """Both sets of this name; a task's name has its acquisition behind it, as in restingstate_acq-mb3."""
    limits = None if tasks is None else {"task": [f"{t}_acq-{a}" for t in tasks for a in ("seq", "mb3")]}
    return FolderSource(spark, datadir, types, preprocessed("derivatives/fmriprep", "{subject}_task-{task}", space), ["subject", "task"], limits)


@register("source", "dmcc13")
def dmcc13(spark: SparkSession, datadir: str, types: Sequence[str] = ("BOLD", "T1w", "VBM_CSF", "VBM_GM", "VBM_WM"), sessions: Sequence[str] = ("ses-wave1bas", "ses-wave1pro", "ses-wave1rea"), tasks: Sequence[str] = ("Rest", "Axcpt", "Cuedts", "Stern", "Stroop"), phase_encodings: Sequence[str] = ("AP", "PA"), runs: Sequence[str] = ("1", "2")) -> FolderSource:
    patterns = preprocessed("derivatives/fmriprep-1.3.2", "{subject}_{session}_task-{task}_acq-mb4{phase_encoding}_run-{run}", anatomy="{session}/", reference=False)
    limits = {"session": sessions, "task": tasks, "phase_encoding": phase_encodings, "run": runs}
    return FolderSource(spark, datadir, types, patterns, ["subject", "session", "task", "phase_encoding", "run"], limits)


@register("source", "ucla")
def ucla(spark: SparkSession, datadir: str, types: Sequence[str] = ("BOLD", "T1w", "VBM_CSF", "VBM_GM", "VBM_WM"), tasks: Sequence[str] = ("rest", "bart", "bht", "pamenc", "pamret", "scap", "taskswitch", "stopsignal")) -> FolderSource:
    run = "{subject}/func/{subject}_task-{task}_bold"
    patterns = {
        "BOLD": {"pattern": f"{run}_space-{STANDARD}_preproc.nii.gz", "space": STANDARD, "confounds": {"pattern": f"{run}_confounds.tsv", "format": "fmriprep"}},
        "T1w": {"pattern": f"{{subject}}/anat/{{subject}}_T1w_space-{STANDARD}_preproc.nii.gz", "space": STANDARD},
        **_tissues(f"{{subject}}/anat/{{subject}}_T1w_space-{STANDARD}_class-{{tissue}}_probtissue.nii.gz", STANDARD),
    }
    return FolderSource(spark, datadir, types, patterns, ["subject", "task"], {"task": tasks})


#: Sets of grey-matter volumes: their patterns and keys.
VOLUMES = {
    "camcan_vbm": ("{subject}/mri/m0wp1{subject}.nii.gz", ["subject"]),
    "ixi_vbm": ("{site}/{subject}/mri/m0wp1{subject}.nii.gz", ["site", "subject"]),
    "aomic_id1000_vbm": ("{subject}/mri/mwp1{subject}_run-2_T1w.nii.gz", ["subject"]),
    "ukb_vbm": ("m0wp1{subject}_ses-{session}_T1w.nii.gz", ["subject", "session"]),
}


def _volumes(pattern: str, keys: list[str]):
    def source(spark: SparkSession, datadir: str, types: Sequence[str] = ("VBM_GM",), **limits: Sequence[str]) -> FolderSource:
        return FolderSource(spark, datadir, types, {"VBM_GM": {"pattern": pattern, "space": "IXI549Space"}}, keys, limits)

    return source


for _name, (_pattern, _keys) in VOLUMES.items():
    register("source", _name)(_volumes(_pattern, _keys))

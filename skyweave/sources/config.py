"""Settings of a match: three mappings, from files or given, checked before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from .catalog import Layout

JOINT = ("pos_corr_dist", "int_fracs", "chunk_id_list", "output_save_folder", "include_perturb_auf", "include_phot_like", "use_phot_priors", "cf_region_type", "cf_region_frame", "cf_region_points_per_chunk", "make_output_csv")
SIDE = ("cat_name", "cat_csv_file_path", "filt_names", "pos_and_err_indices", "mag_indices", "best_mag_index_col", "chunk_overlap_col", "csv_has_header", "chunk_id_list", "auf_region_frame", "correct_astrometry", "apply_proper_motion")
FRAMES = ("equatorial", "galactic")
#: What either side's settings need where blends are simulated.
BLENDED = ("psf_fwhms", "tri_filt_names", "auf_file_path", "dens_dist")


def loaded(path: str) -> dict:
    """A YAML or JSON file."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ImportError("YAML settings need the yaml module; JSON ones do not") from error
    return yaml.safe_load(text)


@dataclass(frozen=True)
class SideBlends:
    """Widths of the profile by filter, columns and path of the simulated counts of each chunk, and the radius of local densities.

    ``bright`` is the path of simulations of bright sources over more sky, ``galaxies`` has what
    their counts are made of for each filter, ``saturation`` the magnitudes above which counts are fitted.
    """

    fwhms: tuple[float, ...]
    columns: tuple[str, ...]
    path: str
    radius: float
    bright: str | None = None
    galaxies: tuple[dict, ...] = ()
    saturation: tuple[float, ...] = ()


@dataclass(frozen=True)
class SideCalibration:
    """How quoted uncertainties are corrected: a better catalogue's text file, its columns of longitude and latitude, and the sightlines' cutouts.

    ``area`` and ``height`` are in square degrees and degrees, ``radius`` (of local densities) in degrees and ``reach`` (of matches) in arcseconds.
    """

    path: str
    columns: tuple[int, int]
    sightlines: tuple[tuple[float, float], ...]
    area: float
    height: float
    radius: float
    reach: float
    step: float = 0.5
    least: int = 100
    filter: int = 0


@dataclass(frozen=True)
class SideSettings:
    name: str
    path: str
    filters: tuple[str, ...]
    layout: Layout
    motion: bool
    correct: bool
    reference_epoch: float | None = None
    move_to_epoch: float | None = None
    blends: SideBlends | None = None
    calibration: SideCalibration | None = None


@dataclass(frozen=True)
class Settings:
    radius: float
    fractions: tuple[float, float, float]
    chunks: tuple
    output: str
    csv: bool
    photometry: bool
    priors: bool
    regions: dict
    edges: bool
    a: SideSettings
    b: SideSettings
    blends: bool = False
    trials: int = 10_000
    mag_step: float = 0.1
    #: The folder with the table of the psf algorithm, if the blends are to be simulated by it.
    psf_folder: str | None = None
    #: Whether they are to be simulated in both ways, mixed by signal-to-noise.
    both: bool = False
    #: Chunks that are run and committed together; all where it is 0.
    batch: int = 0


def _number(config: dict, key: str, where: str, positive: bool = False) -> float:
    try:
        value = float(config[key])
    except (TypeError, ValueError) as error:
        raise ValueError(f"{key} should be a number in the {where} settings") from error
    if positive and value <= 0:
        raise ValueError(f"{key} should be above zero in the {where} settings")
    return value


def _integers(config: dict, key: str, where: str) -> tuple[int, ...]:
    values = config[key] if isinstance(config[key], (list, tuple)) else [config[key]]
    try:
        numbers = [float(v) for v in values]
    except (TypeError, ValueError) as error:
        raise ValueError(f"{key} should hold integers in the {where} settings") from error
    if any(not n.is_integer() or n < 0 for n in numbers):
        raise ValueError(f"{key} should hold integers in the {where} settings")
    return tuple(int(n) for n in numbers)


def epoch(value) -> float:
    """A year, from a number, a Julian epoch such as J2015.5, or a date."""
    text = str(value)
    if text[:1] == "J":
        return float(text[1:])
    if text.count("-") == 2:
        year, month, day = map(int, text.split("-"))
        before = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)[month - 1]
        leap = year % 4 == 0 and (year % 100 or year % 400 == 0)
        return year + (before + day - 1 + (leap and month > 2)) / (366 if leap else 365)
    return float(text)


def _side(config: dict, where: str, blended: bool) -> SideSettings:
    for key in SIDE:
        if key not in config:
            raise ValueError(f"{key} is missing from the {where} settings")
    mags, astro = _integers(config, "mag_indices", where), _integers(config, "pos_and_err_indices", where)
    if len(mags) != len(config["filt_names"]):
        raise ValueError(f"filt_names and mag_indices differ in length in the {where} settings")
    if len(astro) < 3:
        raise ValueError(f"pos_and_err_indices needs three places in the {where} settings")
    snrs = _integers(config, "snr_indices", where) if config.get("snr_indices") is not None else ()
    if snrs and len(snrs) != len(mags):
        raise ValueError(f"snr_indices and mag_indices differ in length in the {where} settings")
    motion = bool(config["apply_proper_motion"])
    if motion and "pm_indices" not in config:
        raise ValueError(f"pm_indices is missing from the {where} settings")
    halo = config["chunk_overlap_col"]
    layout = Layout(
        astro=astro[:3], mags=mags, best=_integers(config, "best_mag_index_col", where)[0], halo=None if halo in (None, "None", -1) else int(halo), snrs=snrs,
        motion=_integers(config, "pm_indices", where) if motion else (), id=config.get("id_col"), header=bool(config["csv_has_header"]),
        epoch=_place(config["ref_epoch_or_index"]) if motion else None, extras=_integers(config, "extra_col_nums", where) if config.get("extra_col_nums") is not None else (), extra_names=tuple(config.get("extra_col_names") or ()),
    )
    if len(layout.extras) != len(layout.extra_names):
        raise ValueError(f"extra_col_names and extra_col_nums differ in length in the {where} settings")
    epochs = [None if not motion or k[0] == "r" and layout.epoch is not None else epoch(config[k]) for k in ("ref_epoch_or_index", "move_to_epoch")]
    if config.get("download_tri"):
        raise ValueError(f"download_tri asks for downloads of simulations, which the engine does not have, in the {where} settings")
    blends = None
    if blended:
        for key in BLENDED:
            if key not in config:
                raise ValueError(f"{key} is missing from the {where} settings, and include_perturb_auf needs it")
        if not len(config["psf_fwhms"]) == len(config["tri_filt_names"]) == len(mags):
            raise ValueError(f"psf_fwhms and tri_filt_names need an entry for each filter in the {where} settings")
        blends = SideBlends(tuple(map(float, config["psf_fwhms"])), tuple(config["tri_filt_names"]), config["auf_file_path"], _number(config, "dens_dist", where, True), config.get("auf_bright_file_path"), *_galaxies(config, where, len(mags)))
    return SideSettings(config["cat_name"], config["cat_csv_file_path"], tuple(config["filt_names"]), layout, motion, bool(config["correct_astrometry"]), *epochs, blends, _calibration(config, where) if config["correct_astrometry"] else None)


def _calibration(config: dict, where: str) -> SideCalibration | None:
    """What corrections are computed from, if the settings say so; otherwise the caller gives them."""
    if not config.get("correct_astro_csv_file_path"):
        return None
    for key in ("correct_astro_pos_indices", "correct_astro_sightlines", "correct_astro_area", "correct_astro_height", "correct_astro_dens_dist", "correct_astro_nn_radius"):
        if key not in config:
            raise ValueError(f"{key} is missing from the {where} settings, and correct_astro_csv_file_path needs it")
    numbers = (_number(config, f"correct_astro_{k}", where, True) for k in ("area", "height", "dens_dist", "nn_radius"))
    columns = _integers(config, "correct_astro_pos_indices", where)
    if len(columns) != 2:
        raise ValueError(f"correct_astro_pos_indices needs two places in the {where} settings")
    sightlines = tuple((float(x), float(y)) for x, y in config["correct_astro_sightlines"])
    return SideCalibration(config["correct_astro_csv_file_path"], columns, sightlines, *numbers, float(config.get("correct_astro_mag_step", 0.5)), int(config.get("correct_astro_least", 100)), int(config.get("correct_astro_mag_index", 0)))


def _place(value) -> int | None:
    """The column of an integer that is too small to be a year."""
    return value if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1000 else None


def _galaxies(config: dict, where: str, filters: int) -> tuple[tuple[dict, ...], tuple[float, ...]]:
    """What galaxy counts are made of and the saturation of each filter, if the counts are to be fitted."""
    if not config.get("fit_gal_flag"):
        return (), ()
    for key in ("gal_parameters", "saturation_magnitudes"):
        if len(config.get(key) or ()) != filters:
            raise ValueError(f"{key} needs an entry for each filter in the {where} settings, as fit_gal_flag is set")
    given = tuple(loaded(g) if isinstance(g, str) else dict(g) for g in config["gal_parameters"])
    for one in given:
        for key in ("z", "kcorr", "schechter"):
            if key not in one:
                raise ValueError(f"gal_parameters lacks {key} in the {where} settings")
    return given, tuple(map(float, config["saturation_magnitudes"]))


def settings(joint: dict, a: dict, b: dict) -> Settings:
    """Checked settings of the three mappings."""
    for key in JOINT:
        if key not in joint:
            raise ValueError(f"{key} is missing from the joint settings")
    if joint["include_perturb_auf"] not in (True, False):
        raise ValueError("include_perturb_auf should be true or false")
    blended = joint["include_perturb_auf"]
    sides = _side(a, "first", blended), _side(b, "second", blended)
    if sides[0].name == sides[1].name:
        raise ValueError("cat_name should differ between the two sides")
    if len({joint["cf_region_frame"], a["auf_region_frame"], b["auf_region_frame"]}) > 1 or joint["cf_region_frame"] not in FRAMES:
        raise ValueError("the frames of the three settings should be the same, equatorial or galactic")
    if not list(joint["chunk_id_list"]) == list(a["chunk_id_list"]) == list(b["chunk_id_list"]):
        raise ValueError("the chunk_id_list of the three settings should be the same")
    if len(joint["cf_region_points_per_chunk"]) != len(joint["chunk_id_list"]):
        raise ValueError("cf_region_points_per_chunk should have an entry for each chunk")
    if joint["cf_region_type"] not in ("rectangle", "points"):
        raise ValueError("cf_region_type should be rectangle or points")
    fractions = joint["int_fracs"]
    if not isinstance(fractions, (list, tuple)) or len(fractions) != 3 or not all(0 < float(f) <= 1 for f in fractions):
        raise ValueError("int_fracs should be three shares: bright, field and overlap")
    if joint["include_phot_like"] and not joint["use_phot_priors"] and joint.get("strict_priors"):
        raise ValueError("likelihoods without priors are not allowed where strict_priors is set")
    for key in ("num_trials", "d_mag"):
        if blended and key not in joint:
            raise ValueError(f"{key} is missing from the joint settings, and include_perturb_auf needs it")
    psf = {bool(config.get("run_psf_auf")) for config in (a, b)}
    if blended and len(psf) > 1:
        raise ValueError("run_psf_auf should be the same in both sides' settings")
    if blended and True in psf and "psf_params_path" not in joint:
        raise ValueError("psf_params_path is missing from the joint settings, and run_psf_auf needs it")
    both = blended and True in psf and all(config.get("run_fw_auf") for config in (a, b))
    if both and not all(side.layout.snrs for side in sides):
        raise ValueError("run_fw_auf and run_psf_auf together need snr_indices on both sides")
    regions = dict(zip(joint["chunk_id_list"], joint["cf_region_points_per_chunk"], strict=True))
    return Settings(_number(joint, "pos_corr_dist", "joint", True), tuple(float(f) for f in fractions), tuple(joint["chunk_id_list"]), joint["output_save_folder"], bool(joint["make_output_csv"]), bool(joint["include_phot_like"]), bool(joint["use_phot_priors"]), {k: (joint["cf_region_type"], v) for k, v in regions.items()}, bool(joint.get("reject_edges", False)), *sides, blended, int(_number(joint, "num_trials", "joint", True)) if blended else 0, _number(joint, "d_mag", "joint", True) if blended else 0.1, joint["psf_params_path"] if blended and True in psf else None, both, int(joint.get("chunks_per_batch", 0)))


def psf_parameters(folder: str) -> tuple[np.ndarray, tuple[float, float, float]]:
    """The table of skew-normal tails and the three fluxes between which it holds, from dd_params.npy and l_cut.npy."""
    table, cuts = (np.load(Path(folder) / f"{name}.npy") for name in ("dd_params", "l_cut"))
    if table.ndim != 3 or table.shape[0] != 5 or table.shape[2] != 2:
        raise ValueError("dd_params should have the shape (5, X, 2)")
    if cuts.shape != (3,):
        raise ValueError("l_cut should have three fluxes")
    return table, tuple(map(float, cuts))

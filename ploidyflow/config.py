"""Settings of a calling run and their checks."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


class ConfigError(ValueError):
    """A setting that cannot be used."""


# Species with the ploidies they are called at, the default species of a ploidy, their model folders, and how the folders of a mode begin.
SPECIES: dict[str, tuple[int, ...]] = {"potato": (4,), "alfalfa": (4,), "rose": (4,), "sweetpotato": (6,), "syn_potato": (6,)}
DEFAULT_SPECIES = {4: "potato", 6: "sweetpotato"}
MODEL_FOLDERS = {
    "potato": "01_C88_Potato_default",
    "alfalfa": "02_Bolivia_Alfalfa",
    "rose": "03_Samantha_Rose",
    "sweetpotato": "04_Tanzania_Sweetpotato_default",
    "syn_potato": "05_SyntheticPotato_Potato",
}
MODES = {"speed": "01_speed_model", "performance": "02_performance_mode"}
PLOIDIES = (4, 6)


@dataclass(frozen=True)
class CallerConfig:
    """Parameters of call_variants; see README for what each one does."""

    ploidy: int = 4
    species: str | None = None
    mode: str = "speed"
    min_af: float = 0.10
    rd_floor: int = 10
    min_mapq: int = 5
    max_indel: int = 20
    window: int = 16
    uppercase_ref: bool = False
    acgt_only: bool = False
    max_depth: int | None = None
    contigs: tuple[str, ...] = field(default=())
    batch_size: int = 8192
    ordinal_join: bool = False

    def checked(self) -> CallerConfig:
        """Itself, if every setting can be used; ConfigError otherwise."""
        if self.ploidy not in PLOIDIES:
            raise ConfigError(f"ploidy must be one of {PLOIDIES}")
        if not 0 < self.min_af < 1:
            raise ConfigError("min_af must lie between 0 and 1")
        if self.rd_floor < 1:
            raise ConfigError("rd_floor must be 1 or more")
        if self.mode not in MODES:
            raise ConfigError(f"mode must be one of {tuple(MODES)}")
        if self.window < 0:
            raise ConfigError("window must be 0 or more")
        if self.ploidy not in SPECIES.get(self.chosen_species(), ()):
            raise ConfigError(f"{self.chosen_species()} isn't called at ploidy {self.ploidy}")
        return self

    def chosen_species(self) -> str:
        return self.species or DEFAULT_SPECIES[self.ploidy]


def model_folder(root: str, species: str, mode: str) -> tuple[str, int]:
    """The species' first model folder of a mode under root, and the window that its name gives as w=<n>."""
    base = os.path.join(root, MODEL_FOLDERS[species])
    if not os.path.isdir(base):
        raise ConfigError(f"no such folder: {base}")
    for name in sorted(os.listdir(base)):
        if name.startswith(MODES[mode]):
            found = re.search(r"w=(\d+)", name)
            if not found:
                raise ConfigError(f"{name} names no window")
            return os.path.join(base, name), int(found[1])
    raise ConfigError(f"no model of mode {mode} in {base}")


def model_files(folder: str) -> tuple[str, str]:
    """Paths of a model folder's model (an ONNX file, or the folder of a saved network) and statistics."""
    found = []
    for names in (("model.onnx", "model"), ("statistics.npz", "statistics.h5")):
        here = [p for p in (os.path.join(folder, x) for x in names) if os.path.exists(p)]
        if not here:
            raise ConfigError(f"{folder} has no {' or '.join(names)}")
        found.append(here[0])
    return found[0], found[1]


def parallelism(asked: int | None, available: int, most: int = 24) -> int:
    """Tasks at once: -1 or None takes what there is, up to a limit; more than there is is cut down."""
    if asked in (None, -1):
        return min(most, available)
    if asked <= 0:
        raise ConfigError("a number of CPUs is -1 or 1 and more")
    return min(asked, available)

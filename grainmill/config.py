"""Settings of the miner and the pipeline, as frozen dataclasses with one meaning each."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class MinerConfig:
    """engine: 'drain' or 'jaccard'. prefix tokens of the tree are depth - 3. masks: 'default', 'extended', 'enhanced' or 'none'."""

    engine: str = "drain"
    sim_th: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = None
    masks: str = "default"
    extra_delimiters: tuple[str, ...] = ()
    collapse_patterns: tuple[tuple[str, str], ...] = ()
    collapse_all: bool = False
    param_binning: bool = False
    affix_preserving: bool = False
    adjacent_fusion: bool = False
    cluster_merge: bool = False
    ael_similarity: bool = False
    max_diff_ratio: float = 0.35
    merge_percent: float = 0.4

    def __post_init__(self):
        if self.depth < 3:
            raise ValueError("depth must be 3 or more")
        if self.engine not in ("drain", "jaccard"):
            raise ValueError(f"no such engine: {self.engine}")
        if self.masks not in ("default", "extended", "enhanced", "none"):
            raise ValueError(f"no such masks: {self.masks}")


@dataclass(frozen=True)
class ControlConfig:
    enabled: bool = True
    max_batch: int = 50
    max_wait_ms: int = 5000
    samples: int = 5
    max_iterations: int = 3
    sampling: str = "first"
    eps: float = 0.5
    min_points: int = 3

    def __post_init__(self):
        if self.sampling not in ("first", "dpp"):
            raise NotImplementedError(f"sampling method {self.sampling!r}")


@dataclass(frozen=True)
class PipelineConfig:
    adapter: str = "raw"
    miner: MinerConfig = field(default_factory=MinerConfig)
    control: ControlConfig = field(default_factory=ControlConfig)

    def merged(self, changes: dict) -> PipelineConfig:
        """A deep merge: nested dictionaries change single settings of a layer."""
        layers = {k: replace(getattr(self, k), **v) if isinstance(v, dict) else v for k, v in changes.items()}
        return replace(self, **layers)


#: Names of the environment settings that a configuration is exported to.
ENV_NAMES = {
    "sim_th": "LOG_PARSER_SIM_TH", "depth": "LOG_PARSER_DEPTH", "max_children": "LOG_PARSER_MAX_CHILDREN", "masks": "LOG_PARSER_EXTENDED_MASKING",
    "ael_similarity": "LOG_PARSER_AEL_SIMILARITY", "adjacent_fusion": "LOG_PARSER_ADJACENT_FUSION", "engine": "LOG_PARSER_ENGINE",
}


def to_dict(config: MinerConfig) -> dict:
    return asdict(config)


def from_dict(values: dict) -> MinerConfig:
    values = dict(values)
    if "collapse_patterns" in values:
        values["collapse_patterns"] = tuple(map(tuple, values["collapse_patterns"]))
    if "extra_delimiters" in values:
        values["extra_delimiters"] = tuple(values["extra_delimiters"])
    return MinerConfig(**values)


def to_env(values: dict) -> str:
    """NAME=value lines for the settings that are given (None is not), in a fixed order."""
    lines = []
    for key, name in ENV_NAMES.items():
        value = values.get(key)
        if value is None:
            continue
        if key == "masks":
            value = value in ("extended", "enhanced")
        if key == "engine":
            value = {"drain": "Drain", "jaccard": "JaccardDrain"}[value]
        lines.append(f"{name}={str(value).lower() if isinstance(value, bool) else value}")
    return "\n".join(lines)

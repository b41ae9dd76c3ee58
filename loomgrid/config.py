"""Clock, constants and default parameters shared by every job."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace

# Markets, calendar and vocabularies the results depend on.
TIME_ZONE = "America/Mexico_City"
SYSTEMS = ("SIN", "BCA", "BCS")
MARKETS = ("MDA", "MTR")
EPOCHS = {"MDA": datetime.date(2016, 1, 29), "MTR": datetime.date(2017, 1, 27)}
MTR_LAG_DAYS = 8
MAX_NODES_PER_REQUEST = 20
MAX_DAYS_PER_REQUEST = 7
RETRY_STATUSES = (429, 500, 502, 503, 504)
UNKNOWN = "UNKNOWN"
REGIONS = (
    "CENTRAL",
    "NORESTE",
    "NOROESTE",
    "NORTE",
    "OCCIDENTAL",
    "ORIENTAL",
    "PENINSULAR",
    UNKNOWN,
)
PRICES = ("pml", "pml_ene", "pml_per", "pml_cng")
COMPONENTS = ("pml_ene", "pml_per", "pml_cng")
OBSERVED = ("ok", "dst_fill", "dst_merge")
DERIVED = ("interp", "missing")
PENDING = "pending"
SPLITS = ("train", "val", "test")
SUBSETS = ("all", "no_spike", "spike")
VOLATILITY_OPTIONS = ("sigma_over_1000", "log1p_sigma")
SIGMA_TAIL_RATIO = 5.0
LEVEL_MIN_ABS = 10.0
RIDGE_ALPHAS = (0.1, 1.0, 10.0)
STAGE_QUOTAS = {
    1: {400: "all", 230: "all", 115: 15},
    2: {400: "all", 230: 30, 115: 17},
}
STAGE_REGION = {1: "PENINSULAR", 2: None}
ISSUE_HOUR = 6
PUBLISH_HOUR = 18


@dataclass(frozen=True)
class SeriesSpec:
    """Regular clock of a panel: one row per (keys, step), grouped in blocks.

    A block is the forecast unit (24 hourly steps by default) and covers whole
    days; ``anchor`` is the first day of some block. ``chunk_blocks`` bounds the
    number of blocks any window ever sorts in one group: series are cut into
    chunks of that many blocks, so a single long or hot series spreads over many
    tasks. Results do not depend on it.
    """

    step_seconds: int = 3600
    steps_per_block: int = 24
    anchor: str = "1970-01-01"
    keys: tuple[str, ...] = ("node",)
    chunk_blocks: int = 256

    def __post_init__(self):
        if (self.step_seconds * self.steps_per_block) % 86400:
            raise ValueError("a block must cover whole days")
        if self.chunk_blocks < 1:
            raise ValueError("chunk_blocks must be positive")

    @property
    def block_days(self) -> int:
        return self.step_seconds * self.steps_per_block // 86400

    def with_chunks(self, chunk_blocks: int) -> "SeriesSpec":
        return replace(self, chunk_blocks=chunk_blocks)


@dataclass(frozen=True)
class Settings:
    """Window lengths, guards and thresholds; defaults are the hourly market case."""

    input_blocks: int = 7
    stats_blocks: int = 28
    min_coverage: float = 0.9
    sigma_floor_abs: float = 10.0
    sigma_floor_rel: float = 0.05
    max_interp: int = 3
    max_interp_input: int = 12
    spike_k: float = 4.0
    week_lag: int = 7
    top_k: int = 4
    test_months: int = 6
    val_days: int = 90
    volatility: str = "sigma_over_1000"
    strict_nulls: bool = False

    def __post_init__(self):
        if self.volatility not in VOLATILITY_OPTIONS:
            raise ValueError(f"volatility must be one of {VOLATILITY_OPTIONS}")

    def min_observations(self, spec: SeriesSpec) -> int:
        whole = self.stats_blocks * spec.steps_per_block * self.min_coverage
        return int(-(-whole // 1))

"""Every constant of the analysis, as explicit parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names of scenarios, of metrics and of the dimension for layers, which must match the inputs; and the
# constants of the analysis below.
#: The four scenarios, in the order in which pooled series run one after another.
POOL_ORDER = (("counterclim", "histsoc"), ("obsclim", "histsoc"), ("obsclim", "1901soc"), ("counterclim", "1901soc"))
SCENARIOS = ("obsclim_histsoc", "counterclim_histsoc", "obsclim_1901soc", "counterclim_1901soc")
LAYER_NAMES = ("depth", "levsoi", "layer", "soil_layer", "lev")
METRICS = ("d", "m", "pi", "ddd", "drd")
CELL = ("model", "lat_idx", "lon_idx")


@dataclass(frozen=True)
class Slice:
    """A scored part of one scenario's series: from month t0 on, ``Params.slice_months`` long."""

    number: int
    scenario: int
    t0: int
    climate: str
    soc: str
    period: str


@dataclass(frozen=True)
class Params:
    months: int = 1428  #: length of each scenario's series
    slice_months: int = 360
    scale: int = 3  #: months in a rolling sum
    seasons: int = 12
    plot_a: float = 0.44  #: plotting position (rank - a) / (n + b)
    plot_b: float = 0.12
    gap_months: int = 6  #: shorter runs between the two bounds join their neighbours
    gap_low: float = 0.0
    gap_high: float = 1.0
    severity: float = -1.0  #: an event's minimum is at most this; a cell's is below it
    joined_value: float = -1e-6
    quorum: int = 2  #: more models than this must have a value
    masked_class: int = 30  #: climate class that is masked out
    target_depth: float = 1.0
    pool: tuple[tuple[str, str], ...] = field(default=POOL_ORDER)

    def __post_init__(self):
        if self.months % self.seasons:
            raise ValueError("series must hold whole years")
        if not self.scale <= self.slice_months <= self.months:
            raise ValueError("a slice must hold a rolling window and fit into the series")

    def slices(self) -> list[Slice]:
        """First (EI) and last (RP) slice of each scenario, in pool order."""
        return [Slice(2 * s + p, s, t0, climate, soc, name) for s, (climate, soc) in enumerate(self.pool) for p, (name, t0) in enumerate((("EI", 0), ("RP", self.months - self.slice_months)))]

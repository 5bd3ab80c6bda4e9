"""Parameters of a run, and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Postal codes of the contiguous states.
LOWER48 = (
    "AL", "AR", "AZ", "CA", "CO", "CT", "DE", "FL", "GA", "IA", "ID", "IL",
    "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT",
    "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY",
)
# The county tables also cover the federal district.
LOWER48_DC = LOWER48 + ("DC",)

# Functional type -> abbreviation.
FUNC_TYPE_CODES = {
    "Deciduous broadleaf": "DB",
    "Deciduous conifer": "DC",
    "Drought deciduous broadleaf": "DDB",
    "Evergreen broadleaf": "EB",
    "Evergreen conifer": "EC",
    "Forb": "Forb",
    "Graminoid": "Gram",
    "Semi-evergreen broadleaf": "SEB",
}
AUTUMN_FUNC_TYPE_CODES = {
    "Deciduous broadleaf": "DB",
    "Drought deciduous broadleaf": "DDB",
    "Semi-evergreen broadleaf": "SEB",
}

# Class breaks (deg F) of the temperature-sum anomaly.
BREAKS_GROUNDHOG = (-500.0, -20.0, 20.0, 500.0)
BREAKS_SPRING = (-2000.0, -40.0, 40.0, 2000.0)
BREAKS_AUTUMN = (-4000.0, -200.0, 200.0, 4000.0)
ANOMALY_CLASSES = ("Cool", "Normal", "Warm")


@dataclass(frozen=True)
class Params:
    year: int = 2025
    first_prior_year: int = 2009
    # Early = below this quantile of the pool.
    lowerq: float = 0.05
    min_obs: int = 20
    min_yrs: int = 8
    radius_km: float = 100.0
    elev_buffer: float = 1000.0
    max_prior_no: int = 30
    pheno_class_ids: tuple[int, ...] = (1, 3, 6, 7)
    phenophase_ids: tuple[int, ...] = ()
    # Column that names the phase: class, phenophase or category.
    phase_key: str = "pheno_class_id"
    # Column counted as an individual in a pool.
    unit: str = "id"
    period: tuple[str, str] | None = None
    # Abbreviations of functional types in the report.
    func_types: tuple[tuple[str, str], ...] = tuple(FUNC_TYPE_CODES.items())
    excluded_species: tuple[str, ...] = ("'ohi'a lehua",)
    allowed_states: tuple[str, ...] = LOWER48
    # Outlier test is <= in the radius comparison and < in the state one.
    outlier_inclusive: bool = True
    # Mark outliers as well as early rows in the histograms.
    outliers_in_histogram: bool = False
    bins: int = 60
    # "ellipsoid" (WGS84) or "sphere".
    distance: str = "ellipsoid"
    # Tiles per radius and buckets per elevation buffer of the pool grid.
    tiles_per_radius: int = 8
    elev_steps: int = 8

    @property
    def prior_years(self) -> range:
        return range(self.first_prior_year, self.year)

    @property
    def group_keys(self) -> list[str]:
        return ["common_name", self.phase_key]

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


PLANTS = Params()
AUTUMN = Params(
    pheno_class_ids=(),
    phenophase_ids=(498, 471),
    phase_key="phenophase",
    period=("07-01", "12-31"),
    func_types=tuple(AUTUMN_FUNC_TYPE_CODES.items()),
    outliers_in_histogram=True,
)
ANIMALS = Params(
    pheno_class_ids=(), phase_key="phenophase_category", unit="site_id"
)

"""Fixed values of the tuning design: grids, limits, solver settings and scenarios."""

from dataclasses import dataclass, replace

EN_C_GRID = [1e-3, 3e-3, 1e-2, 3e-2, 1e-1, 1, 3]
EN_L1_GRID = [0, 0.05, 0.2, 0.5, 0.8, 0.95]
L2_C_GRID = [1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 3e-2, 1e-1, 3e-1, 1, 3]
WIDE_EN_C_GRID = [1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 3e-2, 1e-1, 1, 3, 10, 30]
WIDE_L2_C_GRID = [1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 3e-2, 1e-1, 3e-1, 1, 3, 10, 30]
MAX_K, WIDE_MAX_K = 10, 30
MISSING_RATE = 0.5
NEIGHBORS = 5
EN_ITERATIONS, EN_ITERATION_LIMIT = 5000, 20000
L2_ITERATION_LIMIT = 10000


@dataclass(frozen=True)
class Design:
    """Settings of one scenario. A scenario differs from the primary one in a few fields."""

    scenario: str = "primary"
    outer_splits: int = 5
    outer_repeats: int = 5
    inner_splits: int = 3
    inner_repeats: int = 5
    en_c: tuple = tuple(EN_C_GRID)
    en_l1: tuple = tuple(EN_L1_GRID)
    l2_c: tuple = tuple(L2_C_GRID)
    max_k: int = MAX_K
    imputation: str = "half_minimum"
    missing_rate: float = MISSING_RATE
    fail_on_nonconvergence: bool = True


PRIMARY = Design()
SCENARIOS = {
    "primary": PRIMARY,
    "knn": replace(PRIMARY, scenario="knn", imputation="knn"),
    "kmax30": replace(PRIMARY, scenario="kmax30", max_k=WIDE_MAX_K),
    "outer3": replace(PRIMARY, scenario="outer3", outer_splits=3),
    "reggrid": replace(
        PRIMARY,
        scenario="reggrid",
        en_c=tuple(WIDE_EN_C_GRID),
        l2_c=tuple(WIDE_L2_C_GRID),
        fail_on_nonconvergence=False,
    ),
}

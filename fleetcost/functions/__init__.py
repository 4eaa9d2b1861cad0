"""Column helpers shared by all plans."""
from fleetcost.functions.columns import (  # noqa: F401
    by_scenario, classify, clean_token, col, effective_at, fmt_number, normalise_key, round_half_up,
)

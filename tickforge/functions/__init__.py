from tickforge.functions.columns import (  # noqa: F401
    safe_div, not_true, full_avg, full_std, pct, signal_when,
)

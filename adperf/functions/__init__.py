from adperf.functions.exprs import (
    guarded_ratio,
    npround,
    safe_ratio,
    title_case,
    strip_ws,
)

__all__ = ["guarded_ratio", "npround", "safe_ratio", "title_case", "strip_ws"]

from tidewatch.functions.exprs import (guarded_ratio, nan_to_null, present, window_start,
                                      zero_as_one)
from tidewatch.functions.hashing import hash_hex, hash_int, hash_unit
from tidewatch.functions.order_stats import group_quantiles, rank_cuts

__all__ = ["guarded_ratio", "nan_to_null", "present", "window_start", "zero_as_one",
           "hash_hex", "hash_int", "hash_unit", "group_quantiles", "rank_cuts"]

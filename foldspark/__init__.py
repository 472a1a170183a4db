"""Descriptive statistics over columns and array columns, as Spark plans.

``foldspark.mean(df, "x", by="g")`` and its 23 siblings return DataFrames; ``foldspark.functions.columns`` has them as
aggregate expressions, ``foldspark.functions.arrays`` as expressions inside array rows, ``foldspark.operators.eager`` as
Python values, and ``foldspark.operators.trusted`` under names that carry the NaN policy.
"""

from .functions.policy import Policy
from .operators import frame as _frame
from .operators.frame import reduce
from .plans.config import (
    apply_parallel_grains_config,
    apply_saved_parallel_grains_on_import,
    clear_parallel_grains_config,
    get_default_parallel_grains,
    get_num_threads,
    get_parallel_grains,
    load_parallel_grains_config,
    parallel_grains_config_path,
    save_parallel_grains_config,
    set_axis_order_grain,
    set_axis_scan_grain,
    set_minmax_1d_grain,
    set_parallel_grain,
    set_parallel_grains,
    use_default_parallel_grains,
)

apply_saved_parallel_grains_on_import()
globals().update({name: getattr(_frame, name) for name in _frame.NAMES})

__all__ = [
    *_frame.NAMES,
    "Policy",
    "apply_parallel_grains_config",
    "clear_parallel_grains_config",
    "get_default_parallel_grains",
    "get_num_threads",
    "get_parallel_grains",
    "load_parallel_grains_config",
    "parallel_grains_config_path",
    "reduce",
    "save_parallel_grains_config",
    "set_axis_order_grain",
    "set_axis_scan_grain",
    "set_minmax_1d_grain",
    "set_parallel_grain",
    "set_parallel_grains",
    "use_default_parallel_grains",
]

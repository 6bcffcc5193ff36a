from tidewatch.functions.expressions import (  # noqa: F401
    hash_key, hash_uniform, margin_to_probability, nan_to_null, number, quoted, ratio, ratio_or_zero, real, text, to_double, xlogx,
)
from tidewatch.functions.grids import GRIDS, Grid  # noqa: F401

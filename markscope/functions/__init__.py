"""Column builders: pure Spark SQL expressions, no Python UDFs."""

from markscope.functions.positions import (  # noqa: F401
    first_position,
    literal_positions,
    multi_positions,
    next_char_distance,
    overlapping_positions,
    regex_positions,
)
from markscope.functions.text import (  # noqa: F401
    highlight,
    java_quote,
    trim_start,
)

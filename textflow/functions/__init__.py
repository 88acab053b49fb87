"""Column -> Column expressions.  Built-in expressions only; those with lambdas (``sentence_vote``) are interpreted, the rest is generated code."""

from textflow.functions.incident import (  # noqa: F401
    location_type, ordinal_day, hour_of, entry_side, entry_point, weekday_of,
    grid_key, narrative_section, sentence_vote, search_messy, signature_act,
    property_secured, fingerprint,
)
from textflow.functions.distance import (  # noqa: F401
    grid_distance, hour_gap, weekday_gap, abs_gap, nominal_match,
)

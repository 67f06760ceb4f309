"""Column functions (all JVM-side except ``nfkc``)."""

from furlong.functions.text import (  # noqa: F401
    WHITESPACE, trim_ws, blank_to_null, sql_lpad, pad_start, leading_digits,
    trailing_digits, clean_null_markers, nfkc, to_str,
)
from furlong.functions.codes import (  # noqa: F401
    VENUE_CODES, TRACK_CODES, SCORE_BANDS, venue_code, venue_name, track_name,
    score_band,
)
from furlong.functions.race_id import (  # noqa: F401
    RACE_ID_PATTERN, is_race_id, race_id_parts, build_race_id, format_race_date,
    kaiji_nichiji, race_key_exprs, runner_key_exprs,
)

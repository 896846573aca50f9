from .datetime import find_datetime_col, parse_datetime
from .format import fmt_num, fmt_p, mean_sd, n_pct, pct, pct_label
from .numeric import df_num, round_r, to_num
from .text import clean_string, is_missing_categorical, non_blank

__all__ = [
    "clean_string", "non_blank", "is_missing_categorical",
    "to_num", "df_num", "round_r",
    "fmt_num", "pct", "n_pct", "fmt_p", "pct_label", "mean_sd",
    "find_datetime_col", "parse_datetime",
]

"""Column -> Column helpers.  All run inside whole-stage codegen: no UDFs."""

from spendlens.functions.numeric import (  # noqa: F401
    coerce_numeric, to_count, round_money, to_cents, nan_to_null, is_na_token,
    round_to,
)
from spendlens.functions.dates import parse_dates, week_start  # noqa: F401
from spendlens.functions.metrics import (  # noqa: F401
    cpa, roas, ctr, conversion_rate, delta_pct, safe_ratio,
)
from spendlens.functions.labels import (  # noqa: F401
    currency_label, roas_label, delta_label, title_label, ratio_label,
    money2_label, signed_pct_label,
)

from holdfast.functions.scalars import (  # noqa: F401
    bin_label, binary_flag, blank, bucket_index, fixed, hard_label, is_missing_token, percent,
    ratio, risk_level, risk_title, signed, strip, to_number,
)

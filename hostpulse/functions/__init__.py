"""Column helpers shared by the operators."""

from hostpulse.functions.columns import (
    alert_key,
    blank_to_null,
    compute_once,
    first_reason,
    is_blank,
    micros,
    percent_message,
    repeated_error_rule,
    token_hash,
    utf16_length,
    whole_seconds_between,
)

__all__ = [
    "alert_key",
    "blank_to_null",
    "compute_once",
    "first_reason",
    "is_blank",
    "micros",
    "percent_message",
    "repeated_error_rule",
    "token_hash",
    "utf16_length",
    "whole_seconds_between",
]

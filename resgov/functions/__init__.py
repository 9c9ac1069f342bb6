"""Column functions: every helper returns a ``Column`` built from Spark
built-ins, so it stays inside whole-stage codegen on the executors."""

from .text import py_strip, stripped_length, is_truthy, truthy_or
from .times import ntz, midnight_as_written, trunc_seconds, parse_instant, epoch_millis_ntz, elapsed_seconds
from .labels import (state_class, type_label, card_class, approver_label, expiry_flag,
                     expiry_warning, error_class, row_key, date_label)
from .foundation import FOUNDATION_PREFIXES, entity_display_name, is_foundation, endpoint_description

__all__ = [
    "py_strip", "stripped_length", "is_truthy", "truthy_or",
    "ntz", "midnight_as_written", "trunc_seconds", "parse_instant", "epoch_millis_ntz", "elapsed_seconds",
    "state_class", "type_label", "card_class", "approver_label", "expiry_flag",
    "expiry_warning", "error_class", "row_key", "date_label",
    "FOUNDATION_PREFIXES", "entity_display_name", "is_foundation", "endpoint_description",
]

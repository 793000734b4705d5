"""Column functions over text and time."""

from tapeloom.functions.clean import clean_text, clean_ws
from tapeloom.functions.redact import redact_text, redaction_hits
from tapeloom.functions.terms import redact_term_table
from tapeloom.functions.timing import format_ts, midpoint

__all__ = ["clean_text", "clean_ws", "format_ts", "midpoint", "redact_term_table", "redact_text", "redaction_hits"]

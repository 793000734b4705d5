"""Structured Streaming forms of the operators."""

from tapeloom.streaming.streams import log_stream, redact_stream, split_stream, tail_bucket_stream, tail_step_stream, thin_by_event_time, thin_stream

__all__ = ["log_stream", "redact_stream", "split_stream", "tail_bucket_stream", "tail_step_stream", "thin_by_event_time", "thin_stream"]

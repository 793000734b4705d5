"""Reading and writing of text files and of the run log."""

from tapeloom.sources.files import append_log, out_name, read_log, read_split, read_texts, redaction_report, split_payloads, write_files, write_reports, write_texts

__all__ = ["append_log", "out_name", "read_log", "read_split", "read_texts", "redaction_report", "split_payloads", "write_files", "write_reports", "write_texts"]

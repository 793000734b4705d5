"""DataFrame operators over recordings, keyed by media_id, and over the run log."""

"""locusframe."""

"""Sources (readers) and sinks (writers)."""

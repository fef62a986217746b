"""Facts that arrive as streams, and snapshots that replace one another whole."""

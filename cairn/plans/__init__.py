"""The query catalogue and its oracles."""

"""Part of the Shelfwise engine."""

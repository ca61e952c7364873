"""Part of the quarry analytics engine."""

"""Part of the wayfold engine."""

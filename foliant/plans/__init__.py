"""Query catalogue and presets."""

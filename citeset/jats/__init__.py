"""jats of citeset."""

"""streaming of citeset."""

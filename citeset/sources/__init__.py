"""sources of citeset."""

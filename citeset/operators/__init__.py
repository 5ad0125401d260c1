"""operators of citeset."""

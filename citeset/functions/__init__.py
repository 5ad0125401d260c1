"""functions of citeset."""

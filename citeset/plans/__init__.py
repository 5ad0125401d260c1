"""plans of citeset."""

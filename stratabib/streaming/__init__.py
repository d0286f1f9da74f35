"""streaming of stratabib."""

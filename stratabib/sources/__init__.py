"""sources of stratabib."""

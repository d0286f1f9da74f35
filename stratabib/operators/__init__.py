"""operators of stratabib."""

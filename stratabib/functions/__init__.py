"""functions of stratabib."""

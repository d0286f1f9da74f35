"""plans of stratabib."""

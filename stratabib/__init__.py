"""stratabib: PySpark-native bibliometric, text-signal and corpus-preparation operators."""

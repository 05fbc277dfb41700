"""The same plans over an arriving corpus."""

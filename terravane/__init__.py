"""Spark DataFrame library for gridded daily series and geolocated hazard events."""

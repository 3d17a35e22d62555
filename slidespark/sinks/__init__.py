"""Sinks: text, GeoJSON, NumPy, PNG, OME-TIFF and OME-Zarr."""

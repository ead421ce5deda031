"""Raster and map-algebra operators over pixel tables.

A raster is a DataFrame with one row per pixel: `row`, `col` (ints, from the upper
left), one column per band, and any number of key columns that tell rasters apart.
"""

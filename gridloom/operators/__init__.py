"""Physical forms of the raster operators: functions of pixel relations."""

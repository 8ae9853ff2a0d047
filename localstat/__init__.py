"""Local spatial and spatio-temporal statistics as plain Spark DataFrame functions."""

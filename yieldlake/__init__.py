"""Leak-free preparation and evaluation of manufacturing quality data on Spark."""

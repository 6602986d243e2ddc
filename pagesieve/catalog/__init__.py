"""Detector catalogs: data only."""

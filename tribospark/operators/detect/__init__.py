"""Anomaly detectors, each fitted per joint."""

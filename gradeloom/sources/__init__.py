"""Scans, sinks and manifests."""

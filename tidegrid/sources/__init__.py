"""Readers and writers of packet logs, windows and manifests."""

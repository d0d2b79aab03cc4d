"""Live extraction and streaming snapshots."""

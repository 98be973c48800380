"""penalytics.sources."""

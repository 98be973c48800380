"""penalytics.functions."""

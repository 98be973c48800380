"""penalytics.streaming."""

"""penalytics.operators."""

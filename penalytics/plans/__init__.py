"""penalytics.plans."""

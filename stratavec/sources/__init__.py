"""Vector sources and sinks and the dataset catalog."""

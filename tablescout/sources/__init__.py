"""Sources of datasets."""

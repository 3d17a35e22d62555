"""Level plans, the dataset catalog and export names."""

"""Public-notice analytics and training-data preparation as plain PySpark plans."""

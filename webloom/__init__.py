"""Web-document analytics on PySpark: page cleaning, classification, ranking, discovery and evaluation."""

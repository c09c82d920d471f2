"""tidewell: governed retrieval and corpus analytics as PySpark DataFrame plans."""

"""Search and analytics over chat sessions and other text collections, on Spark."""

"""siftworks package."""

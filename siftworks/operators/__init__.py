"""siftworks operators."""

"""siftworks functions."""

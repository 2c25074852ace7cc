"""siftworks streaming."""

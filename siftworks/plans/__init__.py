"""siftworks plans."""

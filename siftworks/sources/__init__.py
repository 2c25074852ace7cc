"""siftworks sources."""

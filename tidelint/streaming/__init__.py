"""Row-wise qualification of streams."""

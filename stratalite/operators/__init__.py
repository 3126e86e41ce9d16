"""operators of the stratalite library."""

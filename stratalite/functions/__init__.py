"""functions of the stratalite library."""

"""plans of the stratalite library."""

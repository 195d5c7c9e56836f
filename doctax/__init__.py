"""Document-to-taxonomy mapping as DataFrame operators."""

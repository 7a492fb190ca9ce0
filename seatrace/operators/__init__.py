"""DataFrame-to-DataFrame operators over position reports."""

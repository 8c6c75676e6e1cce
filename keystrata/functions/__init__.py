"""Part of the content-addressed analytics engine."""

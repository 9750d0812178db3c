"""The reports: each takes cleaned (and filtered) postings and returns a small frame."""

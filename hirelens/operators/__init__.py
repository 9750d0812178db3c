"""Reusable operators on posting frames: filters, domains, ranking, quantiles."""

"""Filters, thinning, statistics, observation operators and ensembles."""

"""DataFrame operators: features, curation, sampling, metrics, scoring."""

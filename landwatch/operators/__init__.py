"""DataFrame operators: drift, freshness, signals, failures, sensitivity, JSON, coverage, entities."""

"""DataFrame operators: quotas, response quality, codebooks."""

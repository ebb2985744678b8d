"""Column functions: arrays, vector metrics, sparse vectors, distributions, stemming."""

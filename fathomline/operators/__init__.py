"""DataFrame operators that are not plain SQL: as-of joins, merges, episodes, and kernels over ordered groups."""

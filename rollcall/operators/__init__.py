"""DataFrame operators: search, identity, access, quality and skew-safe joins."""

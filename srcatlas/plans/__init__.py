"""Plan shapes that several operators share: fixpoints, interval joins, as-of lookups, priority unions."""

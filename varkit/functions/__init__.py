"""Column-level helpers: typing, NaN folding, long form, binary search, distribution tails."""

"""Plan builders shared by the operators: skew-safe scans, order statistics, small tables."""

"""Domain tables shaped from the driver's tables, the registered queries and their SQL checks."""

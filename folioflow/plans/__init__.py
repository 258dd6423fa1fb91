"""Which conversions exist, which route a pair takes, and what it costs."""

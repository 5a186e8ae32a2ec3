"""Edit plans: comparing, validating and laying them out in time."""

"""Multi-step jobs composed from operators, and the checks over the driver tables."""

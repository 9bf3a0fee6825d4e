"""Multi-stage plans: the layered solve, play, and verification."""

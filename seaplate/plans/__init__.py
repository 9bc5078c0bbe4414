"""The three analyses, each composed from operators into one lazy plan."""

"""Part of pathloom: sources."""

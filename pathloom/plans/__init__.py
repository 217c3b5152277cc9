"""Part of pathloom: plans."""

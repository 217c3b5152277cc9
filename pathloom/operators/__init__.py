"""Part of pathloom: operators."""

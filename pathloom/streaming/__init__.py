"""Part of pathloom: streaming."""

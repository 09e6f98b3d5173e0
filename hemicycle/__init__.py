"""Document-centred analytics on Spark: profiles, linkage, comparison and statistics over weighted labels."""

"""Plans: operators composed into the reference's end-to-end jobs, and the
catalog of queries bound to the landed test tables."""

"""Named queries over the stored tables, with their SQL twins."""

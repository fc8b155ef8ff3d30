"""Table-to-table operators grouped by what they do to a recording."""

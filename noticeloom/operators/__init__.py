"""DataFrame operators: extraction, matching, duplicates, publication, listing, reports."""

"""Plans: from the input tables to the planning reports."""

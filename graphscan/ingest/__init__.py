"""From source files to code graphs."""

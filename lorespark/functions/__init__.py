"""See README for the operators kept here."""

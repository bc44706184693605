"""See README.md for the operators kept here."""

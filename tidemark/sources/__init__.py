"""Tables of the domain, as views over files."""

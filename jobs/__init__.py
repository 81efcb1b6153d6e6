"""Jobs that run from the command line; each is a function that takes a session."""

"""Tables of the program representation, the wire reader and writer, text sinks, the command line."""

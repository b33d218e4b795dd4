"""Where lines come from: files, tables, standard input, and a generator of sample logs."""

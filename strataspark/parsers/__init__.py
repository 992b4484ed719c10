"""Source parsers: file contents to imports, functions, structs and evidence."""

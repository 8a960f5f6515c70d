"""From text to statements: lexer, statement classes and parser of the dialect."""

"""Texts that operators must take."""

#: Nulls, empty and blank texts, ties and repeated rows, a very long word and a long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b c d e f"), (5, "x" * 5000), (6, "word " * 3000), (7, "été\u00a0<s> [INST] ok\n" * 3)]

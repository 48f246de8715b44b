"""Rows shared by the tests of the subpackage."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))

#: Nulls, empty, blank, long, tied and repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog by the old river bank"),
    (2, "the quick brown fox jumps over the lazy dog by the old river bank"),
    (3, None),
    (4, ""),
    (5, " \t\n\n "),
    (None, "a text without a number that nobody can name"),
    (None, None),
    (7, "seven comes twice"),
    (7, "seven comes twice"),
    (8, "eight has one text"),
    (8, "and another text"),
    (9, LONG),
    (10, "Ünïcödé 日本語 テキスト 🙂🙂 ende"),
]

"""Rows that no operator may stumble over."""

LONG = "word" * 30_000 + " " + "naïve £ text 日本語 🎉 " * 5_000

#: Nulls in each column, empty and very long texts, repeated rows and ties.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (None, "a text without an id", "en", None),
    (5, LONG, "en", "b"), (6, "the same row twice", "en", "b"), (6, "the same row twice", "en", "b"), (7, "the same row twice", "de", "b"),
    (8, "mail me at jane.doe@example.org or +44 20 7946 0958", "en", "c"), (9, "\x00 nul \x85 and <|endoftext|> odd spaces", "fr", "c"), (10, "x", "en", "c"),
]

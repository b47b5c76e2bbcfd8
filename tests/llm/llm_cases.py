"""Awkward documents that several tests use."""

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, block int, row string, score string, kept int, "
    "n_words string, tokens string, piece string, carry string, guest int, `end` string, length string, rank string, part string"
)
PLAIN = (
    "The quick brown fox jumps over the lazy dog while seven wizards brew a quiet potion of silver leaves near the old "
    "mill by the river under a pale moon.\nA second line tells of boats and bridges, lanterns and rain.\n\nThe third part ends here."
)
OTHER = " ".join(f"word{i}" for i in range(70))
LONG = " ".join(f"tok{i % 997}x{i % 13}" for i in range(40_000))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "r", "x", 3, "w", "t", "p", "c", 1, "e", "l", "k", "q")


ROWS = [
    row(3, PLAIN), row(1, OTHER), row(2, None), row(4, ""), row(5, PLAIN), row(6, " \n\t \n\n "), row(7, LONG), row(8, "One word"),
    row(8, "One word"), row(9, "ça été déjà vu, naïve œuvre", None, None), row(None, OTHER), row(10, PLAIN + " " + OTHER), row(11, "12 34 !!"),
    row(12, "  a b ▁ c<|endoftext|>d"),
]

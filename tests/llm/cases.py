"""Awkward documents that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size int, component string, spans string, rank int, _id long, _sha string, kept_id int, KEPT_SHA256 string"

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing in old trees near our house".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 4) % 7))
    return " ".join(out)


def documents() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text and word, ties, repeated rows and ids."""
    long = sentence(5, 12_000)
    near = sentence(6, 80)
    texts = {
        1: "Hello there, this is a plain text. Write to Jane.Doe+x@mail.example.org or call +44 (20) 7946-0958 now.",
        2: None, 3: "", 4: " \n\t ", 5: long, 6: long, 7: "a" * 30_000, 8: near, 9: near + " and more", 10: near.replace("fox", "cat"),
        11: "One  two\nthree", 12: "One two three", 13: "一二三 四五六 Привет мир größe", 14: "12345 67890 !?", 15: "x", 16: "a b", 17: "A B",
        18: sentence(1, 40) + " " + sentence(2, 60), 19: sentence(3, 40) + " " + sentence(2, 60), 20: sentence(2, 60) + sentence(2, 60),
        21: "card 4111 1111 1111 1111 and 10.0.0.255, 300.1.1.1 <|endoftext|> a@b@c.de <|startoftext|>", 22: "ab" * 400,
    }
    rows = [(i, t, "en" if i % 3 else None, "s", len(t) if t else None, 1, 2, "c", "x", 3, 4, "y", 5, "z") for i, t in texts.items()]
    rows.append((None, sentence(8, 30), *[None] * 12))
    rows.append((None, near, "en", None, 5, *[None] * 9))
    rows.append(rows[7])  # the same row again
    rows.append((12, "another text under a known number", "en", "s", 3, 1, 2, "c", "x", 3, 4, "y", 5, "z"))
    return rows

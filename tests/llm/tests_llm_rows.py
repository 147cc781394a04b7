"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, odd ids."""

#: Names that the operators use inside, as extra columns of the input.
CLASHING = ("id", "key", "h", "fp", "line", "lines", "home", "group", "n", "part", "band", "first", "slot", "shard", "size", "offset", "component", "spans", "n_words", "row", "node", "least", "__id", "__h", "__hash", "__key", "__places", "__part")

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", ","]) for _ in range(n))


LONG = prose(1, 6000)
SHARED = prose(2, 80)

ROWS = [
    (1, f"{prose(3, 30)}\n{SHARED}\n{prose(4, 30)}", "en"),
    (2, f"{prose(5, 20)}\n{SHARED}\n{prose(6, 25)}", "en"),
    (3, f"{prose(3, 30)}\n{SHARED}\n{prose(4, 30)}", "en"),
    (4, None, None),
    (5, "", "en"),
    (6, " \t\r\n\x0b ", "de"),
    (7, LONG, "en"),
    (8, LONG + " more", None),
    (9, "one", "en"),
    (9, "one", "en"),
    (9, "another of the same id", "fr"),
    (None, f"{SHARED}", "en"),
    (None, "no id here\nno id here", None),
    (10, "Ünïcödé <|endoftext|> 漢字 \U0001f600   x y z \n\n  q", "zh"),
    (-11, "w" * 5000, "en"),
    (12, " ".join(["again"] * 120), "en"),
]

"""Documents with the awkward cases that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, _id long, _row string"

LONG = "word " * 30_000 + "end."

ROWS = [
    (1, "The same text, twice over, with enough words to be one of the longer ones.", "en", "a", 1, True, 9, 7, "x"),
    (2, "The same  text,\ttwice over, with enough words to be one of the longer\nones.", "en", "b", 1, True, 9, 7, "x"),
    (3, None, "en", "a", None, None, None, None, None),
    (4, "", None, "a", 0, None, 0, None, ""),
    (5, " \t\n ", "de", None, 4, False, 1, 1, "y"),
    (6, LONG, "en", "c", len(LONG), False, 1, 1, "y"),
    (7, "Repeated row.", "en", "c", 13, False, 1, 1, "y"),
    (7, "Repeated row.", "en", "c", 13, False, 1, 1, "y"),
    (8, "É ß 漢字 \U0001F600 a@b.example.com\x0b+1 (988) 555-2485", "fr", "é", 3, None, 1, 1, "z"),
    (None, "No id here.", "en", "a", 11, None, 1, 1, "z"),
    (None, "No id here.", "en", "a", 11, None, 1, 1, "z"),
    (10, "One", "en", None, 3, True, 1, 1, "z"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def key(row):
    return tuple((x is None, x) for x in row)


def water_fill(sizes, weights, total, max_repeat):
    """Targets of sources, found by taking out full sources again and again."""
    full = set()
    while True:
        rest = total - sum(max_repeat * sizes[s] for s in full)
        share = sum(w for s, w in weights.items() if s not in full)
        level = rest / share if share else 0.0
        over = {s for s in sizes if s not in full and weights[s] * level > max_repeat * sizes[s]}
        if not over:
            return {s: float(max_repeat * sizes[s]) if s in full else weights[s] * level for s in sizes}
        full |= over

"""Awkward inputs that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, n_tokens string, score string, fp string, k string"

LINE = "the quick brown fox jumps over the lazy dog near the river bank today"
OTHER = "pack my box with five dozen liquor jugs and then walk home slowly please"


def rows():
    texts = [
        (1, f"{LINE}\n{OTHER}"), (2, f"intro words here\n{LINE}\n{OTHER}\nouttro"), (3, None), (4, ""), (5, f"{LINE}\n{OTHER}"), (5, f"{LINE}\n{OTHER}"),
        (None, f"{LINE} once more"), (6, "é" * 70), (7, "é" * 70 + "x"), (8, "one"), (9, "word " * 30000), (10, " \n\t "), (11, "a | b | c"), (12, "mail me@example.com %%%"),
    ]
    return [(i, t, None if i == 3 else "en", None if i == 4 else f"src{(i or 0) % 3}", None, "x", "y", "z", "f", "k") for i, t in texts]


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

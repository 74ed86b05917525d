"""Rows that every operator must take: nulls, empty and long texts, repeats, and columns whose names the operators use inside."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, key int, size int, stats string, score double, g int, row int, _id int, `a b.c` int"
LONG = "lorem ipsum dolor sit amet " * 4000 + "end"


def documents(spark, more=()):
    tail = (None,) * 10
    rows = [
        (1, "One two three four five six seven", "en", "a", 3, *tail),
        (1, "One two three four five six seven", "en", "a", 3, *tail),
        (2, "one two three four five six seven", "en", None, None, *tail),
        (3, None, None, "b", None, *tail),
        (4, "", "en", "b", 0, *tail),
        (5, " \t\n\x0b\x0c\r ", "en", "b", 0, *tail),
        (None, "no id at all", "fr", "c", 1, *tail),
        (7, LONG, "en", "a", 1, *tail),
        (8, "Ünïcödé blank ▁ ▁ 한국어 😀 \x00", "de", "a", 1, *tail),
        (9, "word", "de", "a", 1, *tail),
        (1, "another text under a known id", "en", "a", 3, *tail),
    ]
    return spark.createDataFrame([*rows, *[(*m, *tail) for m in more]], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

"""One small table of awkward documents: nulls everywhere, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, kept boolean, score double, size int, mixed string, held_out string, counts int, row long")


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    en, de = ["the", "and", "other", "with", "Is", "of,", "then."], ["der", "und", "für", "ßen", "Über", "ein,", "ist."]

    def prose(words, size):
        return " ".join(rng.choice(words) + rng.choice(["", "a", "en", "ly"]) for _ in range(size))

    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(en if lang == "en" else de, rng.randrange(25, 90)), lang, f"s{i % 4}" if i % 7 else None))
    rows += [
        (100, None, "en", "s1"), (101, "", None, "s1"), (102, " \n\t\x0b\x0c\r ", "de", None), (103, "one", "en", "s2"),
        (104, "12 34 ##", "de", "s2"), (105, prose(en, 9000), "en", "s3"), (None, prose(en, 40), None, None),
        (None, None, None, None), (106, "a\nb\na\nb\n" * 40, "en", "s0"), (107, "x" * 50_000, "en", "s0"),
        (108, "ñ é ü 漢字 \U0001f600 " * 20, "de", "s3"), (109, prose(en, 40) + " &&& ### $$$ " * 40, "en", "s1"),
    ]
    rows += [rows[3]] * 5 + [rows[4]]
    full = [(*r, None if r[1] is None else len(r[1]), "clash", True, 0.5, 7, "m", "h", 3, 9) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

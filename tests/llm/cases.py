"""Documents with every awkward case, and columns whose names clash with those that operators use inside."""

LONG = "lorem ipsum dolor sit amet " * 40_000


def awkward(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "s1", 3),
        (2, "alpha beta gamma delta epsilon zeta", "en", None, 3),
        (2, "alpha beta gamma delta epsilon zeta", "en", None, 3),
        (3, None, None, "s2", None),
        (4, "", "en", "s2", 0),
        (5, " \t\n\x0b\x0c\r ", "en", None, 7),
        (6, "one", "en", "s1", 3),
        (None, "alpha  beta gamma delta epsilon zeta", "en", "s1", 3),
        (None, None, None, None, None),
        (7, "Crème brûlée – 漢字 \U0001f600 end", "fr", "s3", 3),
        (8, LONG, "en", "s3", len(LONG)),
        (9, "a\n b \n\n c  <|endoftext|> d's !!", "en", "s3", 4),
    ]
    rows = [r + (0, "x", "y", 5, 1.5, "z", 2, 3, "w") for r in rows]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, key string, size int, "
        "score double, h string, rid int, n_tokens int, __k string",
    )


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLASHES = ("__k", "__key", "__times", "__at", "Shard", "__h", "__cut", "__time", "__cell", "__rank", "a.b", "c`d", "Slot", "__m0", "MIX_times")


def clashing(spark, rows):
    """(doc_id, text, source) rows with columns of names that operators use inside, and a map: each row has values of its own."""
    names = "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, "
    names += ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES)
    made = [(i, t, "en", s, len(t or ""), {"k": k}, *(f"{c}{k}" for c in CLASHES)) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(made, names)


def whole(rows, without=()):
    """Rows as comparable values, by column name."""
    return sorted((tuple((c, str(v)) for c, v in sorted(r.asDict().items()) if c not in without) for r in rows), key=repr)

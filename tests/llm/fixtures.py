"""Documents with all that an operator must bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, rank int, size string, score double, kind string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 7, 1, "x", 0.5, None)


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    long_text = words(rng, 30_000)
    rows = [
        row(1, None),
        row(2, ""),
        row(3, " \n\t "),
        row(4, "word"),
        row(5, "Two words", None, None),
        row(6, long_text, "de", "b"),
        row(7, long_text, "de", "b"),
        row(8, "naïve café 漢字 \x00 ՘ \U00010940 🙂 <|endoftext|> ▁x", "fr", None),
        row(9, "x" * 50_000, None, "b"),
        row(10, "a a a a a a a a a a"),
        row(None, "no id here at all", None, "c"),
        row(11, words(rng, 80)),
    ]
    return rows + [rows[3], rows[11]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def save(spark, folder, rows, **tables):
    """rows as the folder's documents, and other tables as (rows, schema)."""
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)

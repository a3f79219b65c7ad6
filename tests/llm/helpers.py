"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string"
TEXTS = [
    "The quick brown fox\njumps over  the lazy dog.",
    None,
    "",
    " ",
    "a",
    "  lead and trail  ",
    "Éléphant naïve nbsp 　 wide sep",
    "▁mark ▁ marks a▁b",
    "tabs\tand\r\nlines\n\n\nmore",
    "x" * 5000,
    "word " * 3000,
    "The quick brown fox\njumps over  the lazy dog.",
    "<|endoftext|> </s> <s> it's we'll 123abc 𝔸 emoji 😀😀",
    "\x00\x01 control \x1c sep \x85 nel",
]


def rows():
    out = [(i * 7 - 3, t, "en", ["a", "b", None, "Z"][i % 4], 1, 5, "clash") for i, t in enumerate(TEXTS)]
    return [*out, out[0], (None, "null id text here", None, None, None, None, None)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def documents_dir(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)

"""A small table of odd rows: nulls, empty and long texts, equal rows, one id with two texts, and columns of clashing names."""

LONG = "word " * 30_000 + "end"
LINE = "this line is long enough to be looked at by the rule of forty"
ROWS = [
    (1, "The cat sat on the mat and looked at the dog for a while.\n" + LINE, "a"),
    (1, "The cat sat on the mat and looked at the dog for a while.\n" + LINE, "a"),
    (1, "another text of the same id\n" + LINE.upper() + "  ", "b"),
    (2, None, "a"),
    (3, "", None),
    (4, LONG, "a"),
    (5, "\n\n \t\n", "b"),
    (6, "  " + LINE + "\nb\n" + LINE, None),
    (7, LINE, "a"),
    (8, "x\n" + LINE, "c"),
    (None, LINE + "\nz", "a"),
    (None, None, None),
    (9, "é" * 50 + "\x00　▁ ￿ <s> </s>\r\n" + "漢字" * 40, "a"),
    (10, "!!! ... ---", "a"),
]
EXTRA = ["ids", "n_tokens", "decoded", "row_no", "position", "shard", "slot", "n_rows", "copy_no", "rate", "shuffle_key", "n_lines", "n_dropped", "score", "kept", "_id", "_row", "_n", "_text", "_bucket", "_source", "h1", "h2", "node", "first", "label", "host", "_h1", "_first", "_stays", "_lost", "doc"]


def table(spark, rows=ROWS):
    """documents-like columns and the clashing ones, each holding 7."""
    full = [(i, t, "en", s, None if t is None else len(t), *[7] * len(EXTRA)) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA))


def empty(spark):
    return table(spark).limit(0)


def key(rows):
    return sorted(map(tuple, rows), key=repr)

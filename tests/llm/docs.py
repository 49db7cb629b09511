"""Small document tables that hold what operators must survive."""

ODD = [
    (1, "Plain text with some words in it.", "en", "s1", 33),
    (1, "Plain text with some words in it.", "en", "s1", 33),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (None, "A row without an id but with words.", "en", "s1", 34),
    (4, " \n\t \n", "en", "s1", 5),
    (5, "naïve café — “quoted” 東京 🙂 words " * 3, "xx", "s2", 100),
    (6, "word " * 30000, "en", "s1", 150000),
    (7, "x" * 60000, "en", "s1", 60000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "text_hash", "key", "length", "rank", "start", "fp", "u", "v", "component", "pos", "hash", "line", "bucket", "_text", "n", "page_id", "host", "path", "verdict", "value", "n_deleted", "n_removed", "score", "kept", "spans", "component_id", "grp", "rep", "members", "th", "runs", "items", "n_matched", "predicted", "held_out", "label", "distance", "rule", "piece")


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows=ODD):
    df = table(spark, rows)
    return df.selectExpr("*", *(f"'x' as {c}" for c in CLASHES))


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)

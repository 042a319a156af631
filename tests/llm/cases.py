"""Rows with nulls, empty and long texts, repeats, and columns of clashing names."""

LONG = "lorem ipsum dolor " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, `row` string, term string, component_id long, page_id long"
TEXTS = {
    1: "the quick brown fox jumps over the lazy dog again and again today",
    2: None,
    3: "",
    4: " \t\n ",
    5: LONG,
    6: "one",
    7: "ünïcödé wörds äre fïne ñandú mañana señor über straße déjà",
}


def rows():
    out = [(k, t, None, None, None, k, 0.5, "x", None, 9, 8) for k, t in TEXTS.items()]
    return [*out, out[0], (None, "the quick brown fox jumps over the lazy dog again and again today", "en", None, None, None, None, None, "t", None, None)]


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)

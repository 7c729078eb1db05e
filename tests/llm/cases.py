"""Documents with everything that an operator must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, key string, kept boolean, slot long, words string"
LONG = "alpha beta gamma delta " * 20_000


def rows():
    base = " ".join(f"word{k}" for k in range(80))
    near = " ".join("other" if k == 7 else f"word{k}" for k in range(80))
    texts = [base, base, near, None, "", "   \n\t ", LONG, "ab", "x\ny\nx\nx", "Ünïcode façade " * 30, base + "\n" + "tail of another kind " * 5]
    out = [(k, t, None if k == 3 else "en", None if k == 4 else "s", None, 0.5, 7, "k", True, 3, "w") for k, t in enumerate(texts)]
    out.append((None, "a text without an id at all", None, None, None, None, None, None, None, None, None))
    out.append(out[0])  # a repeated row
    return out


def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)

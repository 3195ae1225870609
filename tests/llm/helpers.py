"""Small awkward tables: nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"score": "7D", "bucket": "'x'", "component_id": "1L", "words": "1", "digest": "'d'", "kept": "false",
           "ids": "array(1)", "a": "1", "b": "2", "first": "3", "component": "4", "part": "5", "edge": "'e'"}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    out, word = [], ""
    for c in lower(text or ""):
        if c in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def docs(spark, rows, clash=True):
    """A table of documents from (doc_id, text) pairs, with columns that operators might use themselves."""
    got = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    return got.selectExpr("*", *(f"{v} AS {k}" for k, v in CLASHES.items())) if clash else got


def awkward(long_words=4000):
    base = " ".join(f"w{k % 97}x{k % 13}" for k in range(120))
    return [(5, None), (6, ""), (7, " \t\n "), (None, base), (None, None), (8, "One"), (9, "one two"), (10, "ONE"),
            (1, base), (2, base.upper()), (3, base + " more words"), (4, base.replace("w5x", "v5x")), (1, base),
            (20, " ".join(f"z{k}" for k in range(long_words))), (21, "é ü 日本 " * 30), (-3, base + " tail")]

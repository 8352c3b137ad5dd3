"""Documents tables of odd cases."""

WORDS = [f"w{i * 7919 % 997}x" for i in range(400)]
LONG = " ".join(f"long{i % 701} word{i}" for i in range(30_000))


def body(k, n=60):
    return " ".join(WORDS[(k * 31 + i * (k % 5 + 1)) % 400] for i in range(n))


def odd_texts():
    """Nulls, empty and blank texts, ties, copies, near copies, shared passages and lines, marks and one very long text."""
    shared = " ".join(f"shared{i}" for i in range(25))
    line = "This very common line is long enough"
    texts = [None, "", " \t\n ", "one", "Two words", "a b c", "<|endoftext|> x<|endoftext|>y It's  \x0bnaïve ÀÉ 12,5!!\r\n\x85z"]
    texts += [body(k) for k in range(6)]
    texts += [body(3), body(3).upper(), body(4) + " changed", "new " + body(4), body(5) + "\n" + line, line + "\n" + body(6) + "\n  " + line.upper() + " \n"]
    texts += [f"{body(20 + k, 30)} {shared} {body(40 + k, 30)}" for k in range(4)]
    texts += [f"{line}\n{body(60 + k, 52)}" for k in range(3)]
    texts += ["again " * 200, "x y " * 60 + body(7), shared, LONG, LONG + " more", "\n".join([line] * 5), "tail \n\n tail\n"]
    near = body(90, 120).split()
    texts += [" ".join([*near[:k], f"edit{k}", *near[k + 1 :]]) for k in range(0, 100, 4)]
    return dict(enumerate(texts))


def write_documents(spark, folder, texts):
    """A documents table with further columns whose names clash with those of the results."""
    rows = [(i, t, "en", None if (i or 0) % 7 == 3 else f"src{(i or 0) % 2}", len(t or ""), i, "x", "y") for i, t in texts]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, doc string, kept string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")

"""Documents with the awkward cases every operator must survive."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, id long, n int, hash string"
WORDS = "the and of to that with from this which for ing tion ered thing other where never sound light water".split()


def prose(n: int, seed: int) -> str:
    out = []
    for i in range(n):
        seed = (seed * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(seed >> 8) % len(WORDS)] + str((seed >> 16) % 50 or ""))
    return " ".join(out)


def awkward(texts: list[str | None]) -> list[tuple]:
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t) if t is not None else None, 1, 2, 3, "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, texts):
    return spark.createDataFrame(awkward(texts), DOCS)

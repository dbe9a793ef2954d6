"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_docs():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    near = list(base)
    near[7] = "edit"
    chain = list(near)
    for k in (20, 40, 60, 80, 100):
        chain[k] = f"x{k}"
    texts = [
        None, "", " \n\t ", "one", "one two", " ".join(base), " ".join(base), " ".join(near), " ".join(chain), " ".join(base).upper(),
        "a b c\nd e f\ng h i\nrest", "other\na b c\nd e f\ng h i", "a b c\nd e f\ng h i\na b c\nd e f\ng h i", "same\n" * 6, "x" * 5000,
        " ".join(rng.choice(words) for _ in range(30000)), "Grüße éàç 中文 😀 <|endoftext|> it's 12  3\r\n\n  x", "1 " * 3000, "1.2." * 2000, "12-34 " * 800,
    ]
    rows = [(k, t, None if k % 4 == 0 else "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows + [rows[5], (None, "one two three", None, None, 13), (None, None, None, None, None)]

"""Quality rules as a short-circuit cascade.

A text is kept if it breaks no rule. The base rules (``base_failed``) are checked first, as their measures are part of the
result. The other rules run one after another until one rejects the text; so that little is spent on texts that go, they run
in the order of rejections per cost, both estimated on a sample of at most ``sample`` texts of at most ``SAMPLE_BYTES``. The order changes what a run
costs, never what it returns.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return. Null and empty
texts have no words and fail. Rows, repeated ones too, are judged each on its own; other columns pass through, but for those named as the new ones, in
any case, which are replaced.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import added, column, slices, texts_of, with_columns

#: Fixed values.
SYMBOLS = "#*$%&|<>"
#: Longer texts are not in the sample, which the driver holds.
SAMPLE_BYTES = 100_000
_SPACE = re.compile(r"[\x20\x09-\x0D]")


class Text:
    """A text with its words and lines."""

    __slots__ = ("text", "words", "n_symbols", "word_chars", "lines")

    def __init__(self, text: str) -> None:
        self.text = text
        raw = text.encode("utf-8", "surrogatepass").split()
        self.words = raw
        self.word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        self.lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]

    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def n_repeat_words(self) -> int:
        """Words in windows of three that occur twice or more."""
        w = self.words
        grams = list(zip(w, w[1:], w[2:]))
        if len(set(grams)) == len(grams):
            return 0
        often = Counter(grams)
        total, end = 0, 0
        for k, g in enumerate(grams):
            if often[g] > 1:
                total += k + 3 - max(k, end)
                end = k + 3
        return total


#: Name: the rule, true if it rejects a text (of one word at least). The limits leave out markup, tables, shouting and code.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: t.n_symbols > 0.1 * len(t.words),
    "duplicate_lines": lambda t: len(t.lines) >= 4 and t.n_dup_lines() > 0.3 * len(t.lines),
    "word_length": lambda t: not 2 <= t.word_chars / len(t.words) <= 15,
    "capitals": lambda t: (letters := sum(map(str.isalpha, t.text))) > 0 and sum(map(str.isupper, t.text)) > 0.5 * letters,
    "no_letters": lambda t: sum(map(str.isalpha, t.text)) < 0.5 * t.word_chars,
    "exclamation": lambda t: t.text.count("!!") > 0.1 * len(t.words),
    "ellipsis": lambda t: t.text.count("...") + t.text.count("…") > 0.1 * len(t.words),
}


def cascade(texts: list[str]) -> list[str]:
    """The names of the rules, by rejections per second on these texts, the best first; ties by name."""
    parsed = [t for t in map(Text, texts) if t.words]
    gain = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        hits = sum(map(rule, parsed))
        gain[name] = (hits + 0.5) / (time.perf_counter() - began + 1e-6)
    return sorted(RULES, key=lambda n: (-gain[n], n))


def judge(df: DataFrame, text: str = "text", sample: int = 200, seed: int = 7) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean); drops the text."""
    # taken from the first partitions only, and without the longest texts, as it decides the order alone
    few = df.select(F.col(f"`{text}`").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).sample(fraction=0.05, seed=seed).take(sample)
    order = cascade([r[0] for r in few])
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = added(df.schema, *((n, T.LongType()) for n in longs), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), drop=[text])
    arrow = to_arrow_schema(schema)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for raw in texts_of(column(b, text)):
                t = Text(raw)
                n, again = len(t.words), t.n_repeat_words()
                failed = n < 50 or 100 * again > 50 * n
                rows.append((n, t.word_chars, t.n_symbols, t.n_dup_lines(), again, failed, not failed and not any(RULES[r](t) for r in order)))
            columns = list(zip(*rows)) or [()] * 7
            yield with_columns(b, arrow, {n: pa.array(c, pa.int64() if n in longs else pa.bool_()) for n, c in zip([*longs, "base_failed", "kept"], columns)})

    return df.mapInArrow(judged, schema)

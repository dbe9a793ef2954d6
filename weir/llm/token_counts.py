"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters other than white space, with U+2581 before it. Its tokens are the split into vocabulary
entries of the largest sum of scores; of equal sums, the one whose last token starts first, and so on back. A character in no
entry counts as its UTF-8 bytes, each with the score ``byte_score``. The distinct pre-tokens of a batch are walked as a trie
(sorted, depth first): the forward score of a node, that of the best split of the characters down to it, is computed once for
all words that share it, and a terminal node keeps the number of tokens of its word. A text has the tokens of its pre-tokens.

No public vocabulary at hand comes with unigram scores, so they follow from the order of the vocabulary by Zipf's law: entry
number r (from 0, the single bytes and control entries left out) has the score -ln(r + 2.7), up to a constant for all.

Null and empty texts have no tokens. Each row is counted on its own; other columns pass through, but for those named as the new ones, in any case, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _mapped
from .common import column, texts_of

WORD_START = "▁"
#: About so many bytes of memory go with a word that is kept.
_WORD_BYTES = 150


class UnigramCounter:
    """``scores``: logarithmic scores of the entries. Keeps the counts of words of at most ``keep`` bytes, or those of one batch."""

    def __init__(self, scores: dict[str, float], byte_score: float, keep: int = 24 << 20) -> None:
        self.scores, self.byte_score, self.keep = scores, byte_score, keep
        self.longest = max(map(len, scores), default=1)
        self.lengths: dict[str, tuple[int, ...]] = {}
        for n, end in sorted({(len(x), x[-2:]) for x in scores}, reverse=True):
            self.lengths[end] = (*self.lengths.get(end, ()), n)
        self.known: dict[str, int] = {}
        self.known_bytes = 0

    def _learn(self, words: Iterable[str]) -> None:
        score_of, lengths, byte_score = self.scores.get, self.lengths, self.byte_score
        best, count, above = [0.0], [0], ""
        for word in sorted(words):
            w = WORD_START + word
            shared, most = 0, min(len(above), len(w))
            while shared < most and above[shared] == w[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                top, tokens = -math.inf, 0
                ends = lengths.get(w[max(0, end - 2) : end], ())
                for n in (*ends, *lengths.get(w[end - 1], ())) if end > 1 else ends:
                    if n <= end and (s := score_of(w[end - n : end])) is not None and (s := best[end - n] + s) > top:
                        top, tokens = s, count[end - n] + 1
                if w[end - 1] not in self.scores:
                    size = len(w[end - 1].encode("utf-8", "surrogatepass"))
                    if (s := best[end - 1] + size * byte_score) > top:
                        top, tokens = s, count[end - 1] + size
                best.append(top)
                count.append(tokens)
            self.known[word] = count[len(w)]
            above = w

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        split = [t.split() for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new = {w for w in new if w not in self.known}
        if new:
            self._learn(new)
            self.known_bytes += sum(_WORD_BYTES + len(w) for w in new)
        get = self.known.__getitem__
        out = [len(words) for words in split], [sum(map(get, words)) for words in split]
        if self.known_bytes > self.keep:
            self.known, self.known_bytes = {}, 0
        return out


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    """The counter over the entries of a sentencepiece file, best first; one per worker process."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = sorted(own, key=lambda i: (-sp.get_score(i), i))
    return UnigramCounter({sp.id_to_piece(i): -math.log(r + 2.7) for r, i in enumerate(ranked)}, -math.log(len(ranked) + 2.7))


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``n_words`` and ``n_tokens`` (long) of the whole text. ``vocabulary``: path of a sentencepiece file on every executor."""

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        words, tokens = load(vocabulary).count(texts_of(column(b, text)))
        return {"n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}

    return _mapped(df, [("n_words", T.LongType()), ("n_tokens", T.LongType())], [text], make, 1024)

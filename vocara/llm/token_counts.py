"""Token counts of whole texts with a whole-token shortcut.

Offline, once per process, the vocabulary is encoded by its own library, each entry alone: the
entries that give exactly one token are proven single, and no entry is found to continue past a
white-space mark after another character, so no merge ever crosses such a place. A text therefore
falls apart into its words, each with the blanks before it, and its count is the sum of theirs.
Words among the proven strings count one without further work; only the rest is merged by the
library, word by word, and remembered.

If the proof fails for a vocabulary (an entry with an inner mark, or a normaliser that changes
text), every text goes to the library as a whole; the counts are the same.

Cases: a null or empty text has no bytes and no tokens; a lone surrogate counts as its three
bytes and is replaced before counting tokens, as the library cannot take it; rows without a
doc_id are left out; repeated rows give a row each; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LIMIT = 4096
#: Words remembered per process, and the longest one worth remembering.
REMEMBERED = 400_000
LONGEST = 64


class WordCounts(dict):
    """Tokens of ' ' + word: proven words first, others as the library merges them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [e for i, e in enumerate(entries) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        probe = "a  b\tc ﬁ́ "
        kept = self.model.decode(self.model.encode(probe)) == probe
        self.proven = kept and not any(MARK in e.lstrip(MARK) for e in plain)
        words = [e[1:] for e in plain if e.startswith(MARK) and MARK not in e[1:] and len(e) > 1]
        super().__init__({w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1})
        self.first = len(self)
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word, num_threads=1))
        if len(word) <= LONGEST:
            if len(self) - self.first >= REMEMBERED:
                for old in list(self)[self.first :]:
                    del self[old]
            self[word] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not self.proven or MARK in text:
            return len(self.model.encode(text, num_threads=1))
        parts = text.split(" ")
        if "" not in parts:
            return sum(map(self.__getitem__, parts))
        # blanks belong to the word they precede; those at the end stand alone
        total, blanks = 0, 0
        for i, part in enumerate(parts):
            if part:
                total += self[" " * blanks + part] if blanks else self[part]
                blanks = 0
            elif i < len(parts) - 1:
                blanks += 1
            else:  # marks alone
                total += self[" " * blanks] if blanks else self.lone
        return total


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def _counted(path: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = word_counts(path)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "")
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            tokens = [counts.of(t if t.isascii() else t.encode("utf-8", "replace").decode()) for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": size, "n_tokens": tokens, "over_limit": [n > limit for n in tokens]})

    return run


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document; ``path`` names the vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_counted(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

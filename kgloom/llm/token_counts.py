"""Token counts of whole texts, with a shortcut for words that are one token.

Offline, every vocabulary string is encoded alone: those that are a single
pre-token and merge into exactly their own id are proven. A pre-token that equals
a proven string counts as one without merging; only the rest is merged. The proof
is as large as the vocabulary and is broadcast with it.

Defined cases: null and empty texts have no tokens; a special string inside a text
counts as one; rows without id, repeated rows and an empty table are like any other;
other columns pass through, and one that has the name of the result is an error.
"""
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from kgloom.llm import merges
from kgloom.llm.common import SharedEncoder, add_columns, tokenizer_path

LIMIT = 512
_ADJOINING = re.compile(f"[{merges.WHITE}]{{2}}")


def whole_tokens(path: str) -> list[str]:
    """Texts of vocabulary strings that, encoded alone, give one pre-token and exactly their own id."""
    tables = merges.load(path)
    encoder = merges.Encoder(tables)
    value = {name: b for b, name in enumerate(merges.byte_symbols())}
    proven = []
    for token, string in enumerate(tables["strings"]):
        if not string or string in tables["specials"] or any(c not in value for c in string):
            continue
        try:
            text = bytes(value[c] for c in string).decode("utf-8")
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token
        if encoder.find(text) == [text] and encoder.merge(text) == token.to_bytes(4, "little"):
            proven.append(text)
    return proven


class TokenCounter:
    """Counts tokens; needs tables of ``merges.load`` plus the proven strings under ``whole``."""

    def __init__(self, tables: dict):
        self.encoder = merges.Encoder(tables)
        self.whole = frozenset(tables["whole"])
        self.words = merges.Kept(lambda w: len(self.encoder.merge(w)) // 4, merges.KEPT_WORDS)
        self.spaced = merges.Kept(lambda p: self.count_all(" " + p), merges.KEPT_PIECES)

    def count_all(self, part: str) -> int:
        """Splits with the pattern; proven pre-tokens count as one."""
        whole, words = self.whole, self.words
        if part[:1] == " " and part[1:].isalpha():
            return 1 if part in whole else words[part]
        return sum([1 if w in whole else words[w] for w in self.encoder.find(part)])

    def count(self, text: str) -> int:
        """Tokens of a whole text.

        Where no two white characters adjoin, the pattern never looks past a
        space, so each piece between spaces has a count of its own.
        """
        total = 0
        for part, special in self.encoder.parts(text):
            if special is not None:
                total += 1
            elif _ADJOINING.search(part):
                total += self.count_all(part)
            else:
                pieces = part.split(" ")
                total += self.count_all(pieces[0]) + sum(map(self.spaced.__getitem__, pieces[1:]))
        return total


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text."""
    shared = SharedEncoder(docs.sparkSession, path, whole=whole_tokens(path))

    def make(texts: list) -> list:
        counter = shared.get(TokenCounter)
        return [pa.array([counter.count(t) if t else 0 for t in texts], pa.int64())]
    return add_columns(docs, text_col, StructType().add(out, LongType()), make)


def token_report(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    counted = count_tokens(docs.select("doc_id", "text"), path or tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))

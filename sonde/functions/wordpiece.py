"""WordPiece tokens: pre-tokenizing as an expression, greedy longest match in an Arrow UDF."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words; the no-break space does not.
BLANKS = "\\x{09}-\\x{0D}\\x{20}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
PUNCTUATION = "!-/:-@\\[-`\\{-~"


@dataclass(frozen=True)
class WordPiece:
    """Vocabulary, unknown id, special ids and case folding of a tokenizer file."""

    vocab: dict[str, int]
    unk: int
    specials: dict[str, int]
    lower: bool = False
    longest: int = 100

    @classmethod
    def load(cls, path: str) -> WordPiece:
        with open(path, encoding="utf-8") as f:
            return cls.parse(json.load(f))

    @classmethod
    def parse(cls, spec: dict) -> WordPiece:
        model = spec.get("model") or {}
        if model.get("type") != "WordPiece":
            raise ValueError("model.type must be WordPiece")
        vocab = model.get("vocab")
        if not isinstance(vocab, dict) or not vocab:
            raise ValueError("model.vocab is missing")
        unk = model.get("unk_token", "[UNK]")
        if unk not in vocab:
            raise ValueError(f"unknown token {unk!r} is not in the vocabulary")
        added = {t["content"]: int(t["id"]) for t in spec.get("added_tokens") or [] if "content" in t and "id" in t}
        specials = {name: added.get(name, vocab.get(name)) for name in ("[CLS]", "[SEP]", "[PAD]")}
        pre = spec.get("pre_tokenizer") or {}
        lower = pre.get("type") == "BertPreTokenizer" and bool(pre.get("do_lower_case", False))
        return cls({k: int(v) for k, v in vocab.items()}, int(vocab[unk]), {k: v for k, v in specials.items() if v is not None}, lower)

    def word_ids(self, word: str) -> list[int]:
        """The longest known beginning, then the longest known continuations; one unknown id if any part fails."""
        if len(word.encode("utf-16-le")) // 2 > self.longest:
            return [self.unk]
        out: list[int] = []
        at = 0
        while at < len(word):
            for end in range(len(word), at, -1):
                i = self.vocab.get(("##" if at else "") + word[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return [self.unk]
        return out


def words(c: Column) -> Column:
    """T5: words between blanks; each ASCII punctuation mark is a word."""
    return F.regexp_extract_all(c, F.lit(f"[{PUNCTUATION}]|[^{BLANKS}{PUNCTUATION}]+"), F.lit(0))


def token_ids(c: Column, tokenizer: WordPiece) -> Column:
    """Ids of a text, without [CLS] and [SEP]. A worker looks a word up once."""

    @F.pandas_udf("array<int>")
    def ids(lists: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}
        out = []
        for ws in lists:
            row: list[int] = []
            for w in ws if ws is not None else ():
                got = known.get(w)
                if got is None:
                    got = known[w] = tokenizer.word_ids(w)
                row.extend(got)
            out.append(row)
            if len(known) > 1_000_000:
                known.clear()
        return pd.Series(out)

    return ids(words(F.lower(c) if tokenizer.lower else c))

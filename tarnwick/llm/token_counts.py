"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose merge result a task remembers.
MEMO = 1 << 17
#: Texts of these characters only are split here; all others by the library's own normaliser and splitter. The range
#: is long settled in Unicode, closed under lower case, and holds nothing to compose and no odd blanks.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ÿŒœ‐-‧€]*")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(rest.get(b, b)) for b in range(256)]


LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def prove_whole(path: str) -> frozenset[str]:
    """The pre-tokens (in byte letters) that the model gives as exactly one token: every vocabulary string with a
    word end, merged alone. At most as many as the vocabulary has strings, so the set may be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    end, model = spec["end_of_word_suffix"] or "", load(path).model
    words = [v[: len(v) - len(end)] for v in spec["vocab"] if v.endswith(end) and len(v) > len(end)]
    return frozenset(w for w in words if len(model.tokenize(w)) == 1)


class TokenCounter:
    """Counts a text's tokens: whole pre-tokens count 1, the rest are merged, each once while it is remembered."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok = load(path)
        self.model, self.whole = self.tok.model, whole
        names = [regex.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(names) if names else "(?!)")
        self.plain: dict[str, int] = {}
        self.coded: dict[str, int] = {}

    def _coded(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        n = self.coded.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece))
            if len(self.coded) < MEMO:
                self.coded[piece] = n
        return n

    def _plain(self, piece: str) -> int:
        n = self._coded("".join([LETTERS[b] for b in piece.encode("utf-8")]))
        if len(self.plain) < MEMO:
            self.plain[piece] = n
        return n

    def _part(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            known = self.plain.get
            return sum([known(p) or self._plain(p) for p in PIECES.findall(text.lower())])
        normal = self.tok.normalizer.normalize_str(text)
        return sum(self._coded(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal))

    def count(self, text: str | None) -> int:
        """Special strings inside the text are one token each and end what stands before them."""
        if not text:
            return 0
        found = self.special.findall(text)
        if not found:
            return self._part(text)
        return len(found) + sum(self._part(t) for t in self.special.split(text) if t)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each document.

    The vocabulary file at ``path`` must have a BPE model with word ends behind a lower-casing normaliser; it is read
    by the driver, which proves the whole tokens, and by each Python worker. docs: doc_id, text; other columns are
    ignored. Null text counts as empty; null and repeated ids pass through; an empty table gives an empty result.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(path, whole.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": [counter.count(t) for t in pdf["text"]]})

    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = slim.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("over_limit", F.col("n_tokens") > limit)

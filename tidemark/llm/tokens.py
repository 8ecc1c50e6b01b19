"""Token counts of a byte-level BPE vocabulary with a whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that come back as just their own token are
proven to count as one. Online, a text is cut into pre-tokens by the vocabulary's own pattern:
pre-tokens that are proven strings count one, and only the rest go through the merges, once each.

Edge cases: a null or empty text has no tokens; the strings of special tokens inside a text are
one token each, as the library does by default; long texts are counted whole; repeated rows are
counted one by one.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

#: Fixed value: how byte-level BPE vocabularies of this family cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Merge results kept by a worker, before it starts anew.
MOST_CACHED = 500_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def proven_strings(definition: str) -> list[str]:
    """The vocabulary strings that encode alone as their one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(definition)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    ids = [(i, tok.decode([i], skip_special_tokens=False)) for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in special]
    ids = [(i, s) for i, s in ids if s and "�" not in s]
    return [s for (i, s), e in zip(ids, tok.encode_batch([s for _, s in ids], add_special_tokens=False), strict=True) if e.ids == [i]]


class Counter:
    """Counts tokens of texts; lives in one worker."""

    def __init__(self, definition: str, whole: list[str]):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(definition)
        self.find = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))).split if self.special else None
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > len(self.whole) + MOST_CACHED:
            self.known = dict(self.whole)
        known, total, open_ = self.known, [], []
        for t in texts:
            parts, n = [t], 0
            if self.cut and any(s in t for s in self.special):
                parts = self.cut(t)
                n = len(parts) - 1
            pieces = [x for p in parts for x in self.find(p)]
            try:
                n += sum(map(known.__getitem__, pieces))
                total.append(n)
            except KeyError:
                open_.append((len(total), n, pieces))
                total.append(0)
        rest = list({x for _, _, pieces in open_ for x in pieces if x not in known})
        for x, e in zip(rest, self.tok.encode_batch(rest, add_special_tokens=False), strict=True):
            known[x] = len(e.ids)
        for at, n, pieces in open_:
            total[at] = n + sum(map(known.__getitem__, pieces))
        return total


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more tokens than limit).

    The definition (1.6 MB) and the proven strings (under 1 MB) are read on the driver and sent to
    the workers; both are bounded by the vocabulary."""
    definition = Path(tokenizer or default_tokenizer_path()).read_text(encoding="utf-8")
    sent = docs.sparkSession.sparkContext.broadcast((definition, proven_strings(definition)))
    here: list[Counter] = []

    def count(texts: list[str]) -> dict:
        if not here:
            here.append(Counter(*sent.value))
        n = here[0].counts(texts)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, text_col, [id_col], count, "n_bytes long, n_tokens long, over_limit boolean")

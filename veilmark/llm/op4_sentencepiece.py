"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

Every prefix of a word has one encoding and so one last token. An automaton over the pieces gives all tokens that end at
a position; the one that is the last token is the only one that may follow the last token of the prefix before it, which a
test of the pair alone decides. The ids are then read from the table backwards.

No piece of these models holds a character before a word mark, so a text falls into independent chunks: a run of word
marks with what follows it, cut at characters that no piece holds (they become bytes). Chunks repeat, so a task remembers
a bounded number of them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Chunks that a task remembers as lately used (and as many of the time before), and the longest of them.
REMEMBERED, LONGEST = 150_000, 48


class PrefixTable:
    """Encodes and decodes with the vocabulary of a SentencePiece BPE model with byte fallback and no text normalisation."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)  # read for its vocabulary only
        self.pieces, self.score, self.bytes = {}, {}, {}
        self.text: list[str] = []
        self.byte_of: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[i] = int(piece[1:-1], 16)
                self.bytes[self.byte_of[i]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece], self.score[piece] = i, sp.get_score(i)
            self.text.append("" if sp.is_control(i) else piece.replace(MARK, " "))
        self.known = {p for p in self.pieces if len(p) == 1}
        runs = {p for p in self.pieces if len(p) > 1 and not p.strip(MARK)}
        merged = [p for p in self.pieces if len(p) > 1 and p not in runs]
        lowest = min((self.score[p] for p in merged), default=0)
        if (
            len(self.bytes) != 256
            or any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) for p in merged)
            or any(c not in self.known for p in self.pieces for c in p)
            or len({self.score[p] for p in merged}) != len(merged)
            or any(self.score[p] >= lowest for p in runs)
        ):
            raise ValueError("the model is not a byte-fallback BPE model whose pieces stay within words")
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            if p not in runs:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.tests = 0
        self.names = {p: str(i) for p, i in self.pieces.items()}
        self.runs: dict[int, list[int]] = {}
        self.chunks: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """The defining rule on a short sequence: the best-scored adjacent pair first, the leftmost among equals."""
        while True:
            best = max(((self.score[p], -i) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in self.pieces), default=None)
            if best is None:
                return symbols
            i = -best[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the token ``right`` can follow ``left``; with an empty ``left``, whether it can be the first."""
        self.tests += 1
        if self.tests > 400_000:
            self.fits.clear()
            self.tests = 0
        known = self.fits[left][right] = self.merge(list(left + right)) == ([left, right] if left else [right])
        return known

    def tokens(self, word: str) -> list[str]:
        """Pieces of a word of known characters that holds a mark at its start at most."""
        last: list[str | None] = [None] * (len(word) + 1)
        last[0] = ""
        fits = self.fits
        for end, piece in self.automaton.iter(word):
            if last[end + 1] is None and (left := last[end + 1 - len(piece)]) is not None:
                fit = fits[left].get(piece)
                if fit or fit is None and self.compatible(left, piece):
                    last[end + 1] = piece
        found, at = [], len(word)
        while at:
            found.append(last[at])
            at -= len(last[at])
        return found[::-1]

    def encode_word(self, word: str) -> list[int]:
        return [self.pieces[p] for p in self.tokens(word)]

    def encode_marks(self, n: int) -> list[int]:
        """Ids of a run of n marks that no following piece takes in: merged by score, then from the left."""
        if n not in self.runs:
            widest = max((len(p) for p in self.pieces if not p.strip(MARK)), default=1)
            if n > 4 * widest:  # the left part fills with the widest run before anything to its right can change it
                head = self.merge_marks(4 * widest)
                if head[0] == head[1] == self.pieces.get(MARK * widest):
                    times = n // widest - 2
                    return [head[0]] * times + self.encode_marks(n - times * widest)
            self.runs[n] = self.merge_marks(n)
        return self.runs[n]

    def merge_marks(self, n: int) -> list[int]:
        return [self.pieces[p] for p in self.merge([MARK] * n)]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of marks followed by other characters; unknown characters become their bytes."""
        ids: list[int] = []
        for part in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", chunk):
            marks = len(part) - len(part.lstrip(MARK))
            word, start = part[max(0, marks - 1) :], 0
            first = True
            for i in [*(i for i, c in enumerate(word) if c not in self.known), len(word)]:
                if i > start:
                    got = self.encode_word(word[start:i])
                    if first and marks > 1:
                        alone = got[0] == self.pieces[MARK]
                        got = self.encode_marks(marks - 1 + alone) + got[alone:]
                    ids += got
                first = False
                if i < len(word):
                    ids += [self.bytes[b] for b in word[i].encode("utf-8", "surrogatepass")]
                start = i + 1
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space is dropped, bytes are read as UTF-8, control ids give nothing."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None:
                out.append(self.text[i])
        return "".join(out).removeprefix(" ")

    def chunk(self, chunk: str) -> tuple[str, str]:
        """The ids of a chunk, joined by commas, and what they decode to."""
        known = self.older.get(chunk)
        if known is None:
            if self.known.issuperset(chunk) and not chunk.startswith(MARK * 2):
                pieces = self.tokens(chunk)
                known = (",".join([self.names[p] for p in pieces]), "".join([self.text[self.pieces[p]] for p in pieces]))
            else:
                ids = self.encode_chunk(chunk)
                known = (",".join(map(str, ids)), self.decode([self.pieces[MARK], *ids]))
        if len(chunk) <= LONGEST:
            if len(self.chunks) > REMEMBERED:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = known
        return known

    def split(self, text: str) -> list[str]:
        """Independent chunks of a text, line breaks on their own (no piece holds one)."""
        if not text:
            return []
        if "\n" in self.known:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK))
        return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.split(text) for i in (self.chunks.get(c) or self.chunk(c))[0].split(",")]

    def joined(self, text: str) -> tuple[str, str]:
        """encode() joined by commas, and decode() of it."""
        parts = [self.chunks.get(c) or self.chunk(c) for c in self.split(text)]
        return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts]).removeprefix(" ")


@lru_cache(2)
def _table_of(model: bytes) -> PrefixTable:
    return PrefixTable(model)


def digests(model: bytes):
    """A column function: struct(n_tokens, ids_sha256, decoded_sha256) of a text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _table_of(model)
        for batch in texts:
            rows = []
            for text in batch:
                ids, decoded = own.joined(text or "")
                digest = hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), digest))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode


def encoder(model: bytes):
    """A column function: the ids of a text as array<int>; null and empty texts give an empty array."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _table_of(model)
        for batch in texts:
            yield pd.Series([own.encode(t or "") for t in batch])

    return encode


def decoder(model: bytes):
    """A column function: the text of an array of ids; null and empty arrays give an empty text."""

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _table_of(model)
        for batch in ids:
            yield pd.Series([own.decode([] if x is None else list(x)) for x in batch], dtype=object)

    return decode


def model_bytes(path: str | None = None) -> bytes:
    """The model file; without a path the installed public tokenizer."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each input row.

    Null and empty texts have no tokens. Whole texts are encoded, however long; time is in proportion to their length.
    """
    return docs.select("doc_id", digests(model)(F.col("text")).alias("r")).select("doc_id", "r.*")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_bytes())

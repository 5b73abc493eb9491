"""SentencePiece encoding and decoding with a prefix table.

For merge-type (BPE) models the encoding of a text is found without merging it. For every prefix of the text there is
exactly one token that its encoding ends with: the vocabulary entry that ends there, whose start is itself the end of an
encodable prefix, and that merging would leave beside that prefix's last token. Entries that end at a place come from
an Aho-Corasick automaton; whether two tokens stay side by side is tested by merging just these two, and remembered.
The ids of the whole text are then read off backwards from its end.

No vocabulary entry has a space mark after another character, so nothing merges across the start of a word; nor across
a line end, or between a letter and a sign that no entry has behind a letter. The table is filled between such places,
and what lies between them is looked up when a worker has seen it before.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import BoundedCache, struct_udf, table
from foretrace.llm.registry import query

MARK = "▁"
#: Remembered words and token pairs in each Python worker.
WORDS, PAIRS = 500_000, 400_000
FIELDS = "n_tokens bigint, ids array<int>, decoded string"
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

_models: dict[str, Model] = {}


class Model:
    """One model file: pieces, scores, the automaton, and what was learnt about words and pairs."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        normal = [
            i
            for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))
        ]
        self.piece = {i: lib.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: lib.get_score(i) for p, i in self.id.items()}
        self.decimal = [str(i) for i in range(lib.get_piece_size())]
        self.size = lib.get_piece_size()
        self.end = lib.eos_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space mark inside: words cannot be encoded by themselves")
        alphabet = {c for p in self.id for c in p}
        if not alphabet <= set(self.id):
            raise ValueError("a character of a piece is no piece")
        self.alphabet = alphabet
        self.known = re.compile("[%s]+|." % re.escape("".join(sorted(alphabet))), re.DOTALL)
        self.cut = self._cutter()
        automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            automaton.add_word(p, (len(p), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs = BoundedCache(self._stay, PAIRS)
        self.words = BoundedCache(self._word, WORDS)

    def _cutter(self) -> re.Pattern:
        """Cuts text where no piece crosses: before space marks, around line ends, and between a letter or digit and
        a sign that no piece has behind one."""
        inside = {p[i] for p in self.id for i in range(1, len(p)) if p[i - 1].isalnum()}
        signs = re.escape("".join(c for c in sorted(self.alphabet) if not c.isalnum() and c not in inside and c != MARK))
        if "\n" in self.alphabet:
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        word = rf"{MARK}*[^\W_]+(?=[{signs}{MARK}\n]|\Z)"
        return re.compile(rf"{word}|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")

    def merged(self, symbols: list[str]) -> list[str]:
        """Merging as the model defines it: best score first, then leftmost. Only short strings come here."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _stay(self, key: int) -> bool:
        """Do two tokens (``left * size + right``; left ``size`` for none) stay as they are beside each other?"""
        left, right = divmod(key, self.size)
        tokens = [self.piece[right]] if left == self.size else [self.piece[left], self.piece[right]]
        return self.merged(list("".join(tokens))) == tokens

    def _table(self, text: str) -> list[int]:
        """Ids of a text over the alphabet: fill the prefix table, then walk back."""
        last, begin, size, pairs = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.size, self.pairs
        last[0] = size
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - length
                before = last[start]
                if before >= 0 and pairs[before * size + token]:
                    last[end], begin[end] = token, start
        ids, end = [], len(text)
        while end:
            ids.append(last[end])
            end = begin[end]
        ids.reverse()
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        for part in self.known.findall(word):
            if part[0] in self.alphabet:
                ids += self._table(part)
            else:
                ids += [self.bytes[b] for b in part.encode()]
        return tuple(ids)

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        words = self.words
        ids = [i for chunk in self.chunks(text or "") for i in words[chunk]]
        ids.append(self.end)
        return ids


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _fields(state: Model, text: str | None):
    ids = state.encode(text)
    return len(ids), ids, state.library.decode(ids)


def _digests(state: Model, text: str | None):
    ids = state.encode(text)
    said = " ".join(map(state.decimal.__getitem__, ids))
    decoded = state.library.decode(ids)
    return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encoded(text: Column, path: str) -> Column:
    """A struct of n_tokens, ids with the end id, and the text decoded from these ids.

    Null is encoded as the empty text, which has the end id alone and decodes to the empty text. Texts of any length
    are encoded whole. ``path`` must name the model on every executor.
    """
    return struct_udf(FIELDS, lambda: model(path), _fields)(text)


def digests(text: Column, path: str) -> Column:
    """n_tokens and the SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    return struct_udf(DIGESTS, lambda: model(path), _digests)(text)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``, in no order: its id and the digests; other columns are not carried."""
    out = docs.select(F.col(id_col), digests(F.col(text), path or default_model()).alias("made"))
    return out.select(id_col, "made.*")


@query("op8_sentencepiece")
def op8_sentencepiece(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))


__all__ = ["Model", "digests", "encode_documents", "encoded", "model"]
